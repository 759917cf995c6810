"""Null-safe arithmetic.

Missing values are NULL everywhere.  A division by zero gives NULL instead of
an ANSI error or an infinity, so that aggregates skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUDGE = 1e-7
TINY = 1e-10  # keeps the oscillator denominators away from zero


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(now: Column, then: Column) -> Column:
    """Relative change from ``then`` to ``now``."""
    return F.try_divide(now, then) - F.lit(1.0)


def flag(condition: Column) -> Column:
    """1 if the condition holds, 0 if it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def missing_to_null(value: Column) -> Column:
    """NaN is how pandas-written files spell a missing number."""
    return F.when(~F.isnan(value), value)


def rounded(df, digits: int = 6, **special: int):
    """Round every floating column; ``special`` sets digits by column name.

    Adding zero turns a negative zero into a positive one.  A mean of short
    decimals may end exactly halfway between two results; the special columns
    are nudged off that point, so that noise in the last bits does not show.
    """
    out = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if field.dataType.typeName() not in ("double", "float"):
            out.append(name)
        elif field.name in special:
            out.append(f"round({name} + {NUDGE!r}D, {special[field.name]}) + 0D AS {name}")
        else:
            out.append(f"round({name}, {digits}) + 0D AS {name}")
    return df.selectExpr(*out)
