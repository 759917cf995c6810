"""Pick up new bar files since the last run.

Each micro-batch is written to a folder named after its stream and its number,
replacing what an interrupted attempt may have left there: running again, or
losing an executor half-way, changes nothing.  A new checkpoint is a new stream
and leaves the batches of an older one alone.  Files may overlap in time; the
reader keeps the row of every ``(ticker, date)`` that was loaded last.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.cleaning import dedupe_bars
from barloom.sources.bar_files import parse_raw, read_raw


def refresh_bars(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    intraday: bool = False,
    max_files: int = 10000,
) -> None:
    """Append all CSV files not seen before to the bar log, then stop."""

    def store(batch: DataFrame, number: int) -> None:
        # Spark names a stream in its checkpoint before the first batch runs.
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        paths = [r["path"] for r in batch.collect()]  # of at most max_files files
        bars = parse_raw(read_raw(spark, paths), intraday).withColumn("loaded_at", F.current_timestamp())
        bars.write.mode("overwrite").parquet(f"{table}/stream={stream}/batch={number}")

    # The stream carries names of files; their rows are read batch by batch.
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema)
    found = files.option("maxFilesPerTrigger", max_files).load(folder)
    run = (
        found.select("path").writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def read_bar_log(spark: SparkSession, table: str) -> DataFrame:
    """Current bars: the last load wins, inside a load the last file name."""
    log = spark.read.parquet(table)
    newest = F.struct("loaded_at", "batch", "file_name")
    return dedupe_bars(log, newest).drop("stream", "batch", "file_name", "loaded_at")
