"""Walk-forward evaluation: overlapping test windows over each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.indicators import (
    FEATURE_COLS,
    RSI_PERIOD,
    TARGET_THRESHOLD,
    add_indicators,
    add_target,
)
from barloom.operators.backtest import (
    INITIAL_CAPITAL,
    TRANSACTION_COST,
    equity_curve,
    strategy_returns,
)
from barloom.operators.cleaning import clean_bars, usable
from barloom.operators.evaluation import evaluate_curve
from barloom.operators.features import MIN_ROWS
from barloom.operators.panel import group_panel, index_bars
from barloom.operators.signals import RULES, rule_position

# Default window lengths in rows.
TRAIN_WINDOW = 252
TEST_WINDOW = 63
STEP = 21


def _last_window(train: int, test: int, step: int) -> str:
    return f"floor((n_bars - {train + test}L) / {step}L)"


def walk_forward_windows(
    indexed: DataFrame, train: int = TRAIN_WINDOW, test: int = TEST_WINDOW, step: int = STEP
) -> DataFrame:
    """One row per bar and test window it belongs to, as ``window_id``.

    Window ``k`` tests rows ``k*step + train`` up to ``k*step + train + test``
    and exists while it fits into the series.
    """
    first = f"greatest(0L, ceil((idx - {train + test - 1}L) / {step}L))"
    last = f"least(floor((idx - {train}L) / {step}L), {_last_window(train, test, step)})"
    # sequence() would count downwards where a bar is in no window.
    return (
        indexed.withColumns({"_first": F.expr(first), "_last": F.expr(last)})
        .filter("_first <= _last")
        .withColumn("window_id", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def window_bounds(
    indexed: DataFrame,
    by=("ticker",),
    order: str = "date",
    train: int = TRAIN_WINDOW,
    test: int = TEST_WINDOW,
    step: int = STEP,
) -> DataFrame:
    """First and last date of the train and test part of every window.

    Only the four bars that bound a window are kept; the windows themselves
    are never expanded.
    """
    offsets = {
        "train_start": 0,
        "train_end": train - 1,
        "test_start": train,
        "test_end": train + test - 1,
    }
    last = F.expr(_last_window(train, test, step))

    def entry(name: str, offset: int) -> Column:
        start = F.col("idx") - F.lit(offset)
        k = F.floor(start / F.lit(step))
        fits = (start >= 0) & (start % F.lit(step) == 0) & (k <= last)
        return F.when(fits, F.struct(F.lit(name).alias("edge"), k.alias("window_id")))

    edges = F.array_compact(F.array(*[entry(n, o) for n, o in offsets.items()]))
    rows = indexed.filter(F.size(edges) > 0).select(*by, order, F.inline(edges))
    return rows.groupBy(*by, "window_id").agg(
        *[F.max(F.when(F.col("edge") == n, F.col(order))).alias(n) for n in offsets]
    )


def window_features(
    bars: DataFrame,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    order: str = "date",
    train: int = TRAIN_WINDOW,
    test: int = TEST_WINDOW,
    step: int = STEP,
    rsi_period: int = RSI_PERIOD,
    threshold: float = TARGET_THRESHOLD,
):
    """Indicators computed afresh inside every test window, as a panel.

    The windows are groups of at most ``test`` rows, so the series length does
    not matter here.
    """
    windows = walk_forward_windows(index_bars(bars, by, order), train, test, step)
    windows = windows.withColumnsRenamed({"idx": "_series_idx"}).drop("n_bars")
    keys = (*by, "window_id")
    inside = Window.partitionBy(*keys).orderBy("_series_idx")
    rows = clean_bars(windows).withColumns(
        {
            "idx": (F.row_number().over(inside) - F.lit(1)).cast("bigint"),
            "n_bars": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    panel = group_panel(rows.filter(F.col("n_bars") >= MIN_ROWS), keys)
    return add_target(add_indicators(panel, columns, rsi_period), threshold)


def walk_forward_rule(
    bars: DataFrame,
    rule: str = "sma_cross",
    by=("ticker",),
    order: str = "date",
    train: int = TRAIN_WINDOW,
    test: int = TEST_WINDOW,
    step: int = STEP,
    cost: float = TRANSACTION_COST,
    capital: float = INITIAL_CAPITAL,
) -> DataFrame:
    """Performance and classification metrics of a rule per test window."""
    panel = window_features(bars, RULES[rule][0], by, order, train, test, step)
    panel = panel.add({"position": rule_position(rule), "price": F.col("Close")})
    return evaluate_windows(panel, cost, capital)


def evaluate_windows(panel, cost: float = TRANSACTION_COST, capital: float = INITIAL_CAPITAL):
    """Metrics per group of a panel with ``position``, ``price``, ``target``."""
    curve = equity_curve(strategy_returns(panel, cost=cost), capital)
    return evaluate_curve(curve, panel.by)


def walk_forward_status(
    bars: DataFrame,
    by=("ticker",),
    order: str = "date",
    train: int = TRAIN_WINDOW,
    test: int = TEST_WINDOW,
    step: int = STEP,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Usable rows per window and whether that is enough to evaluate it."""
    windows = walk_forward_windows(index_bars(bars, by, order), train, test, step)
    n_usable = F.count_if(usable())
    return (
        windows.groupBy(*by, "window_id")
        .agg(n_usable.alias("n_rows"))
        .withColumn("evaluated", F.col("n_rows") >= min_rows)
    )
