"""Long/flat backtest: returns, equity curve, drawdown, performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.maths import change, ratio
from barloom.operators.panel import CHUNK_ROWS, Panel, chunk_panel, index_bars

# Defaults of the backtest.
INITIAL_CAPITAL = 10000.0
TRANSACTION_COST = 0.001
TRADING_DAYS = 252

EXTREMES = ("least_return", "largest_return")


def signal_panel(
    signals: DataFrame, by=("ticker",), order: str = "date", chunk_rows: int = CHUNK_ROWS
) -> Panel:
    """Rows with ``position`` and ``price``, each chunk with one earlier row.

    Positions from :func:`compute_features` and scored tables are already
    numbered; anything else is numbered here.
    """
    if not {"idx", "n_bars"} <= set(signals.columns):
        signals = index_bars(signals, by, order)
    return chunk_panel(signals, by, before=1, chunk_rows=chunk_rows, order=order)


def strategy_returns(
    panel: Panel,
    position: str = "position",
    price: str = "price",
    cost: float = TRANSACTION_COST,
) -> Panel:
    """Add ``price_return`` and ``returns``.

    The position of the day before earns the return of the day; a change of
    position is paid for on the day of the change.  The first row has none.
    """
    held = F.lag(position, 1).over(panel.row())
    before = F.lag(price, 1).over(panel.row())
    panel = panel.add({"_held": held, "_before": before})
    move = F.coalesce(change(F.col(price), F.col("_before")), F.lit(0.0))
    traded = F.abs(F.col(position) - F.col("_held"))
    panel = panel.add(
        {
            "price_return": move,
            "returns": F.col("_held") * move - traded * F.lit(float(cost)),
        }
    )
    return panel.with_df(panel.df.drop("_held", "_before"))


def equity_curve(
    panel: Panel, capital: float = INITIAL_CAPITAL, price: str = "price", extremes: bool = False
) -> DataFrame:
    """Compound ``returns`` over each series.

    Adds ``cumulative_returns``, ``capital``, ``running_max``, ``drawdown`` and
    ``buy_and_hold``.  Growth is compounded inside the chunks; the growth up to
    the start of a chunk comes from one row of totals per chunk.  ``extremes``
    adds ``least_return`` and ``largest_return`` of the whole series, which come
    with the same totals; ``returns_histogram`` then needs no second reading.
    """
    panel = panel.core()
    growth = F.lit(1.0) + F.col("returns")
    known = F.col("returns").isNotNull()
    panel = panel.add({"_local": F.product(growth).over(panel.so_far())})
    panel = panel.add({"_local": F.when(known, F.col("_local"))})
    panel = panel.add(
        {
            "_local_max": F.max("_local").over(panel.so_far()),
            "_local_min": F.min("_local").over(panel.so_far()),
        }
    )
    if panel.chunked:
        df = panel.df.join(_chunk_carry(panel, growth, price), list(panel.keys))
    else:
        df = panel.df.withColumns(
            {
                "_carry": F.lit(1.0),
                "_peak": F.lit(None).cast("double"),
                "_first_price": F.first(price).over(panel.so_far()),
                "least_return": F.min("returns").over(Window.partitionBy(*panel.keys)),
                "largest_return": F.max("returns").over(Window.partitionBy(*panel.keys)),
            }
        )
    carry = F.col("_carry")
    cum = carry * F.col("_local")
    # Scaling keeps the order of the local values, or turns it round.
    local_peak = carry * F.when(carry >= 0, F.col("_local_max")).otherwise(F.col("_local_min"))
    df = df.withColumns(
        {
            "cumulative_returns": cum,
            "capital": cum * F.lit(float(capital)),
            "running_max": F.greatest(F.col("_peak"), local_peak),
            "buy_and_hold": ratio(F.col(price), F.col("_first_price")) * F.lit(float(capital)),
        }
    )
    drawdown = ratio(F.col("cumulative_returns") - F.col("running_max"), F.col("running_max"))
    if not extremes:
        df = df.drop(*EXTREMES)
    return df.withColumn("drawdown", drawdown).drop(
        "_local", "_local_max", "_local_min", "_carry", "_peak", "_first_price", "blk", "core"
    )


def _chunk_carry(panel: Panel, growth: Column, price: str) -> DataFrame:
    """Growth, peak and first price that each chunk starts from."""
    totals = panel.df.groupBy(*panel.keys).agg(
        F.product(growth).alias("_total"),
        F.max("_local").alias("_high"),
        F.min("_local").alias("_low"),
        F.min_by(price, "idx").alias("_open_price"),
        F.min("returns").alias("_least"),
        F.max("returns").alias("_largest"),
    )
    series = Window.partitionBy(*panel.by).orderBy("chunk")
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns(
        {
            "_carry": F.coalesce(F.product("_total").over(earlier), F.lit(1.0)),
            "_first_price": F.first("_open_price").over(
                series.rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    carry = F.col("_carry")
    top = carry * F.when(carry >= 0, F.col("_high")).otherwise(F.col("_low"))
    totals = totals.withColumn("_top", top)
    # The same order with a frame of all chunks: one sort serves both.
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        *panel.keys,
        "_carry",
        "_first_price",
        F.max("_top").over(earlier).alias("_peak"),
        F.min("_least").over(whole).alias("least_return"),
        F.max("_largest").over(whole).alias("largest_return"),
    )


def perf_sums() -> list[Column]:
    """Aggregates of a curve that the performance figures are made of."""
    r, cum = F.col("returns"), F.col("cumulative_returns")
    last_known = F.when(r.isNotNull(), F.col("idx"))
    return [
        F.count(r).alias("_n"),
        (F.max_by(cum, last_known) - F.lit(1.0)).alias("_total"),
        (F.stddev_samp(r) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("_vol"),
        F.min("drawdown").alias("_drawdown"),
        F.count_if(r != 0).alias("_trades"),
        F.count_if(r > 0).alias("_wins"),
        F.sum(F.when(r > 0, r)).alias("_profit"),
        F.abs(F.sum(F.when(r < 0, r))).alias("_loss"),
    ]


def perf_figures() -> list[Column]:
    """Performance figures out of ``perf_sums``; zeros without any return."""
    empty, zero, vol = F.col("_n") == 0, F.lit(0.0), F.col("_vol")
    base = F.lit(1.0) + F.col("_total")
    # A negative base has no real root: the annual figure is unknown.
    annual = F.when(base >= 0, F.pow(base, F.lit(float(TRADING_DAYS)) / F.col("_n")) - F.lit(1.0))
    gain = ratio(F.coalesce(F.col("_profit"), zero), F.col("_loss"))

    def unless_empty(value: Column) -> Column:
        return F.when(empty, zero).otherwise(value)

    return [
        unless_empty(F.col("_total")).alias("total_return"),
        unless_empty(annual).alias("annualized_return"),
        unless_empty(vol).alias("volatility"),
        F.when(vol > 0, annual / vol).otherwise(zero).alias("sharpe_ratio"),
        unless_empty(F.col("_drawdown")).alias("max_drawdown"),
        F.coalesce(ratio(F.col("_wins"), F.col("_trades")), zero).alias("win_rate"),
        F.coalesce(gain, zero).alias("profit_factor"),
        F.col("_trades").alias("total_trades"),
        F.col("_wins").alias("winning_trades"),
    ]


def perf_metrics(curve: DataFrame, by=("ticker",)) -> DataFrame:
    """Performance of each series: one grouped aggregate over the curve."""
    return curve.groupBy(*by).agg(*perf_sums()).select(*by, *perf_figures())


def backtest_signals(
    signals: DataFrame,
    by=("ticker",),
    order: str = "date",
    cost: float = TRANSACTION_COST,
    capital: float = INITIAL_CAPITAL,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Equity curve of a table with ``position`` and ``price``."""
    panel = signal_panel(signals, by, order, chunk_rows)
    return equity_curve(strategy_returns(panel, cost=cost), capital)


def join_signals(bars: DataFrame, signals: DataFrame, by=("ticker",), order: str = "date"):
    """Bind predictions to prices by key, not by row position."""
    return bars.join(signals, [*by, order])
