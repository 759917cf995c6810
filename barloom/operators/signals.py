"""Rule signals: 0/1 positions from indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.maths import flag
from barloom.operators.backtest import (
    INITIAL_CAPITAL,
    TRANSACTION_COST,
    equity_curve,
    strategy_returns,
)
from barloom.operators.features import feature_panel
from barloom.operators.panel import CHUNK_ROWS

# Equal averages differ in their last bits; a real crossing does not.
EDGE = 1e-9

# Name -> (columns the rule reads, condition for being long).
RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "sma_cross": (("sma_5", "sma_20"), f"sma_5 - sma_20 > {EDGE}D"),
    "macd_trend": (("macd_histogram",), f"macd_histogram > {EDGE}D"),
    "rsi_high": (("rsi",), f"rsi - 50D > {EDGE}D"),
}


def rule_position(rule: str) -> Column:
    return flag(F.expr(RULES[rule][1]))


def rule_curve(
    bars: DataFrame,
    rules=("sma_cross",),
    by=("ticker",),
    order: str = "date",
    cost: float = TRANSACTION_COST,
    capital: float = INITIAL_CAPITAL,
    chunk_rows: int = CHUNK_ROWS,
    bucket_days: int | None = None,
    extremes: bool = False,
) -> DataFrame:
    """Backtest rule signals in one pass over the features.

    Several rules share the indicator pass: each bar is repeated per rule and
    ``model`` becomes part of the series key.
    """
    columns = tuple(dict.fromkeys(c for r in rules for c in RULES[r][0]))
    panel = feature_panel(
        bars, columns, by, order, spare=1, chunk_rows=chunk_rows, bucket_days=bucket_days
    )
    keep = [*panel.keys, order, "Close", "target", "idx", "n_bars", "blk", "core"]
    if len(rules) == 1:
        df = panel.df.select(
            *keep, F.lit(rules[0]).alias("model"), rule_position(rules[0]).alias("position")
        )
    else:
        each = [
            F.struct(F.lit(r).alias("model"), rule_position(r).alias("position")) for r in rules
        ]
        df = panel.df.select(*keep, F.inline(F.array(*each)))
        panel = panel.split_by("model")
    panel = panel.with_df(df.withColumnRenamed("Close", "price"))
    return equity_curve(strategy_returns(panel, cost=cost), capital, extremes=extremes)
