"""Chronological split, scaling statistics, class weights, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.indicators import FEATURE_COLS
from barloom.operators.panel import attach_stats, index_bars

TEST_SIZE = 0.2


def test_start(test_size: float = TEST_SIZE) -> Column:
    """Position of the first test row of a series: ``floor(n * (1 - test_size))``."""
    share = F.lit(1.0) - F.lit(float(test_size))
    return F.floor(F.col("n_bars") * share)


def is_test_row(test_size: float = TEST_SIZE) -> Column:
    """True from the first test row of a series on."""
    return F.col("idx") >= test_start(test_size)


def time_split(features: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Mark the last part of every series as test rows; no shuffle."""
    return features.withColumn("is_test", is_test_row(test_size))


def scaling_stats(rows: DataFrame, columns=tuple(FEATURE_COLS), by=("ticker",)) -> DataFrame:
    """Mean and population deviation of each column; deviation 0 becomes 1."""
    parts = []
    for c in columns:
        parts.append(F.avg(c).alias(f"_mean_{c}"))
        spread = F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
        parts.append(spread.alias(f"_std_{c}"))
    if by:
        parts.append(F.max("n_bars").alias("n_bars"))
    return rows.groupBy(*by).agg(*parts)


def scale_features(
    split: DataFrame, columns=tuple(FEATURE_COLS), by=("ticker",)
) -> DataFrame:
    """Standardise train and test rows with statistics of the train rows."""
    stats = scaling_stats(split.filter(~F.col("is_test")), columns, by)
    if by:
        rows = attach_stats(split, stats, by)
    else:
        rows = split.join(F.broadcast(stats))  # a global aggregate: one row
    scaled = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") for c in columns}
    return rows.withColumns(scaled).select(*split.columns)


def class_weights(rows: DataFrame, by=("ticker",), label: str = "target") -> DataFrame:
    """Balanced weight ``n / (2 * n_class)`` per series and class."""
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(Window.partitionBy(*by))  # two rows per series
    return counts.withColumn("weight", total / (F.lit(2.0) * F.col("n_class")))


def with_class_weight(rows: DataFrame, label: str = "target") -> DataFrame:
    """Attach the pooled class weight as ``class_weight``."""
    weights = class_weights(rows, (), label).select(label, F.col("weight").alias("class_weight"))
    return rows.join(F.broadcast(weights), label)  # one row per class: two


def with_folds(
    rows: DataFrame, folds: int = 3, by=("ticker",), order: str = "date", label: str = "target"
) -> DataFrame:
    """Contiguous folds inside every class of every series, as ``fold``."""
    layout = {"idx": "_idx", "n_bars": "_n_bars"}
    held = rows.withColumnsRenamed({k: v for k, v in layout.items() if k in rows.columns})
    placed = index_bars(held, (*by, label), order)
    fold = F.expr(f"least(idx * {folds}L div n_bars, {folds - 1}L)").cast("int")
    placed = placed.withColumn("fold", fold).drop("idx", "n_bars")
    return placed.withColumnsRenamed({v: k for k, v in layout.items()})
