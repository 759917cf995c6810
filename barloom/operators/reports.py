"""Summary tables: data overview, prediction history, display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.maths import ratio
from barloom.operators.panel import index_bars


def ticker_overview(bars: DataFrame, by=("ticker",), order: str = "date") -> DataFrame:
    """Rows, last close and its change, date range and mean volume."""
    placed = index_bars(bars, by, order)
    from_end = F.col("n_bars") - F.col("idx")
    close = F.col("Close")
    sums = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.when(from_end == 1, close)).alias("latest_close"),
        F.max(F.when(from_end == 2, close)).alias("_previous"),
        F.min(order).alias("first_date"),
        F.max(order).alias("last_date"),
        F.avg("Volume").alias("avg_volume"),
    )
    # A single bar is compared with itself.
    previous = F.when(F.col("n_rows") > 1, F.col("_previous")).otherwise(F.col("latest_close"))
    move = F.col("latest_close") - previous
    percent = F.when(previous > 0, ratio(move, previous) * F.lit(100.0)).otherwise(0.0)
    return sums.select(
        *by,
        "n_rows",
        "latest_close",
        move.alias("change"),
        percent.alias("change_pct"),
        "first_date",
        "last_date",
        "avg_volume",
    )


def history_summary(history: DataFrame) -> DataFrame:
    """Number of predictions, how many say Up, mean confidence."""
    return history.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("prediction") == "Up").alias("up_predictions"),
        F.avg("probability").alias("avg_confidence"),
    )


def fixed(value: Column, pattern: str = "0.00") -> Column:
    """Text with fixed decimals, rounded on the exact binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def percent(value: Column) -> Column:
    return F.concat(fixed(value * F.lit(100.0)), F.lit("%"))


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), fixed(value))


def title_case(value: Column) -> Column:
    """``random_forest`` -> ``Random Forest``."""
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def history_display(history: DataFrame) -> DataFrame:
    """The prediction history as text, with the headings of the report."""
    return history.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Time"),
        F.col("ticker").alias("Ticker"),
        F.date_format("date", "yyyy-MM-dd").alias("Data Date"),
        dollars(F.col("current_price")).alias("Price"),
        F.col("prediction").alias("Prediction"),
        percent(F.col("probability")).alias("Confidence"),
        percent(F.col("prob_up")).alias("P(Up)"),
        percent(F.col("prob_down")).alias("P(Down)"),
        F.col("model_ticker").alias("Model"),
        percent(F.col("model_accuracy")).alias("Model Acc"),
    )


def comparison_display(comparison: DataFrame) -> DataFrame:
    """A model comparison as text."""
    out = {c: percent(F.col(c)) for c in ("accuracy", "total_return", "max_drawdown", "win_rate")}
    out |= {c: fixed(F.col(c)) for c in ("sharpe_ratio", "f1_score")}
    return comparison.withColumns(out)
