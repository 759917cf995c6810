"""Watchlists and the status of a multi-ticker load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line; blank lines and ``#`` comments are skipped."""
    return parse_watchlist(spark.read.text(path))


def parse_watchlist(lines: DataFrame) -> DataFrame:
    name = F.upper(F.trim("value"))
    return (
        lines.select(name.alias("ticker"))
        .filter((F.col("ticker") != "") & ~F.col("ticker").startswith("#"))
        .distinct()
    )


def watchlist_order(spark: SparkSession, path: str) -> list[str]:
    """The listed tickers in file order, for jobs that loop over the list."""
    lines = [row["value"].strip().upper() for row in spark.read.text(path).collect()]
    return list(dict.fromkeys(t for t in lines if t and not t.startswith("#")))


def on_watchlist(bars: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Bars of the listed tickers; Spark broadcasts the list if it is small."""
    return bars.join(watchlist, "ticker", "left_semi")


def ingest_status(
    bars: DataFrame, watchlist: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """What was loaded per listed ticker; a missing one does not stop the rest.

    ``n_bad_dates`` counts rows whose date did not parse.  ``files`` (see
    ``bar_files.file_status``) marks tickers whose files are damaged.
    """
    loaded = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("date").isNull()).alias("n_bad_dates"),
    )
    listed = watchlist.join(loaded, "ticker", "left")
    damage = F.lit(None).cast("string")
    if files is not None:
        damaged = files.filter("problem IS NOT NULL").groupBy("ticker")
        listed = listed.join(damaged.agg(F.min("problem").alias("_problem")), "ticker", "left")
        damage = F.col("_problem")
    rows = F.coalesce(F.col("n_rows"), F.lit(0))
    bad = F.coalesce(F.col("n_bad_dates"), F.lit(0))
    return listed.select(
        "ticker",
        rows.alias("n_rows"),
        "first_date",
        "last_date",
        bad.alias("n_bad_dates"),
        F.when(damage.isNotNull(), F.concat(F.lit("damaged: "), damage))
        .when(rows > 0, "loaded")
        .otherwise("no data")
        .alias("status"),
    )
