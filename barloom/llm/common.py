"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a Python task handles at once (a longer text is handled alone).
SLICE_BYTES = 4 << 20
BATCH_BYTES = 12 << 20

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where none is named, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/barloom-{os.getpid()}"
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage: what stands behind is computed once, and a lost executor costs no more than
    reading files again. Column pruning still applies to later readers. The tables stay under
    ``<shared folder>/barloom-llm`` until the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` that nothing will read again."""
    spark = df.sparkSession
    mark = "/barloom-llm/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if mark in folder and len(folder.rpartition(mark)[2]) == 32:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over; else they stay until the driver happens to collect its
    garbage. What has just ended is held until its last events are handled, so a small job goes first."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


def small_batches(spark: SparkSession) -> None:
    """Lowers the bytes of text that Spark hands to a Python worker at once, if they are more than ``BATCH_BYTES``.

    Spark's own bound (64 MB) exists several times over while a batch is copied, in the executor's heap,
    outside it and in the worker; whole texts of many sizes need no such batches.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine; the next task's worker starts from little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the GNU library
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_bucket(id_col: str | Column, n: int) -> Column:
    """CRC-32 of the id's text, modulo ``n``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")).cast("binary")) % n


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    lengths = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], dtype=np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1``, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
