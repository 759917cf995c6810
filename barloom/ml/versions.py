"""Folders that are replaced as a whole: new contents go to a folder of their own, and one small row makes them the served ones.

The log beside the folders is only appended to. A writer that breaks off before its row is written leaves what
was served before; readers never see half of anything.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

LOG = "version long, folder string"


def served(spark: SparkSession, place: str) -> str | None:
    """The folder that the newest row of the log names; None where nothing was published."""
    try:
        row = spark.read.schema(LOG).parquet(f"{place}/log").orderBy(F.desc("version"), F.desc("folder")).first()
    except AnalysisException:
        return None
    return row["folder"] if row else None


def publish(spark: SparkSession, place: str, write: Callable[[str], object]) -> str:
    """Lets ``write`` fill a new folder of ``place`` and then serves it."""
    version = time.time_ns()
    folder = f"{place}/version={version}-{uuid.uuid4().hex[:8]}"
    write(folder)
    spark.createDataFrame([(version, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{place}/log")
    return folder
