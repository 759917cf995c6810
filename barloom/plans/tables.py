"""Bars derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.session import cut_lineage
from barloom.sources.ticks import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily unit-price bars per brand.

    ``part`` has one row per key; Spark broadcasts it while it is small, else
    it is a sort-merge join whose hot keys adaptive execution splits.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem")
    sequence = {"l_orderkey": 14, "l_linenumber": 4, "l_partkey": 10, "l_suppkey": 10}
    return bars_from_ticks(
        lines.join(part, F.col("l_partkey") == F.col("p_partkey")),
        ticker=F.col("p_brand"),
        ts=F.col("l_shipdate"),
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        size=F.col("l_quantity"),
        sequence=sequence,
        interval="1d",
    )


def kept(bars: DataFrame) -> DataFrame:
    """Bars written once: an operator that reads its input twice then reads bars, not ticks."""
    return cut_lineage(bars)


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event value per event type."""
    return _event_bars(spark, sf_dir, F.col("value"))


def index_level_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a damped level, so that a backtest keeps its capital."""
    return _event_bars(spark, sf_dir, F.lit(100.0) + F.col("value") / F.lit(50.0))


def _event_bars(spark: SparkSession, sf_dir: str, price) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf_dir, "events"),
        ticker=F.col("event_type"),
        ts=F.col("ts"),
        price=price,
        size=F.lit(1.0),
        sequence=["ts", "event_id"],
        interval="1h",
    )
