"""Bar files: one CSV per ticker and date range, or a partitioned table.

Any path a Spark reader takes works: a file, a folder, a glob, a list, a URI of
an object store.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.operators.cleaning import coerce_bars, normalize_bars

# Prices are read as text so that one bad value empties one cell, not a row.
REQUIRED = ("date", "open", "high", "low", "close", "volume")
RAW_NAMES = dict(zip(REQUIRED, ("date", "Open", "High", "Low", "Close", "Volume")))
FILE_NAME = r"^(.+)-\d{4}-\d{2}-\d{2}-\d{4}-\d{2}-\d{2}\.csv(\.gz|\.bz2)?$"
#: Folders of a table written with ``write_bars``.
FOLDER = r"^(.*/ticker=([^/]+))/[^/]+$"
UNKNOWN = "UNKNOWN"
#: Bytes that a check of a packed file unpacks at a time.
PIECE = 1 << 20

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume")],
    ]
)


def _unescaped(path: Column) -> Column:
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def ticker_of(file_name: Column, file_path: Column | None = None) -> Column:
    """Ticker from ``{ticker}-{start}-{end}.csv`` (it may contain ``-``), else from a folder ``ticker=...``."""
    found = F.nullif(F.regexp_extract(file_name, FILE_NAME, 1), F.lit(""))
    if file_path is not None:
        # Spark escapes values in names of folders, and paths once more in its metadata.
        folder = _unescaped(_unescaped(F.regexp_extract(file_path, FOLDER, 2)))
        found = F.coalesce(found, F.nullif(folder, F.lit("")))
    return F.coalesce(found, F.lit(UNKNOWN))


def _plain(cell: Column) -> Column:
    """A cell of a header without mark, quotes, space around it, and case."""
    return F.lower(F.trim(F.regexp_replace(cell, '^\ufeff|"', "")))


def file_layouts(spark: SparkSession, paths) -> list[tuple[list[str], list[str]]]:
    """Column names of CSV files by their first lines, each with the paths of the files that have them.

    First lines are found by an aggregate over the text of first blocks; one row per file leaves the tasks.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.monotonically_increasing_id().alias("_line"),
        _unescaped(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    first = lines.filter((F.col("_start") == 0) & (F.trim("value") != "")).groupBy("path").agg(F.min_by("value", "_line").alias("value"))
    names = F.transform(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), _plain)
    found = first.groupBy(names.alias("names")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [(list(r["names"]), list(r["paths"])) for r in found.orderBy(F.to_json("names")).collect()]


def _layout_problem(names: list[str]) -> str | None:
    if not ("date" in names or {"open", "close"} <= set(names)):
        return "no header"
    lacking = [n for n in REQUIRED if n not in names]
    return f"no column {', '.join(lacking)}" if lacking else None


def _read_layout(spark: SparkSession, names: list[str], paths) -> DataFrame:
    """Text columns of files with one layout; only the needed ones are parsed."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)
    cell = {n: F.col(f"c{names.index(n)}") for n in REQUIRED}
    # A header line further down: the same one is skipped, another one is an error.
    plain = {n: F.coalesce(_plain(c), F.lit("")) for n, c in cell.items()}
    repeated = reduce(lambda a, b: a | b, [c == "date" for c in plain.values()])
    same = reduce(lambda a, b: a & b, [c == n for n, c in plain.items()])
    message = F.concat(F.lit("file "), F.col("_metadata.file_path"), F.lit(" has headers that differ"))
    kept = F.when(~repeated, True).when(same, False).otherwise(F.raise_error(message).cast("boolean"))
    ticker = F.col(f"c{names.index('ticker')}") if "ticker" in names else F.lit(None).cast("string")
    return rows.filter(kept).select(
        ticker.alias("ticker"),
        *[cell[n].alias(shown) for n, shown in RAW_NAMES.items()],
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
    )


def read_raw(spark: SparkSession, paths) -> DataFrame:
    """Text columns ``ticker, date, Open ... Volume``, ``file_name`` and ``file_path``.

    Every file is read by the names in its own first line, in any order and any
    spelling of case; other columns do no harm, and ``ticker`` is NULL in files
    without one. Files are grouped by their layout, and each group is one scan.
    A file with rows but without a header, without a required column, or with two
    different headers is an error that names the file, and so is a file that
    cannot be read to its end (see ``file_status``).
    """
    layouts = file_layouts(spark, paths)
    for names, files in layouts:
        problem = _layout_problem(names)
        if problem:
            raise ValueError(f"file {files[0]} has {problem}")
    if not layouts:
        layouts = [(list(REQUIRED), [])]
    if len(layouts) == 1:
        return _read_layout(spark, layouts[0][0], paths)
    return reduce(DataFrame.unionAll, [_read_layout(spark, names, files) for names, files in layouts])


def parse_raw(raw: DataFrame, intraday: bool = False) -> DataFrame:
    """Typed bars with the ticker of the row, else of the file name."""
    named = ticker_of(F.col("file_name"), F.col("file_path"))
    name = F.coalesce(F.nullif(F.trim("ticker"), F.lit("")), named)
    bars = normalize_bars(raw.withColumn("ticker", name), intraday=intraday)
    return bars.select("ticker", "date", "Open", "High", "Low", "Close", "Volume", "file_name")


def read_bars_csv(spark: SparkSession, paths, intraday=False) -> DataFrame:
    """Bars ``(ticker, date, Open, High, Low, Close, Volume, file_name)``."""
    return parse_raw(read_raw(spark, paths), intraday)


def _unpacked(path: str) -> str | None:
    """What is wrong with a packed file, read in pieces; None if it can be read to its end."""
    import bz2
    import zlib

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    make = bz2.BZ2Decompressor if path.endswith(".bz2") else lambda: zlib.decompressobj(31)
    try:
        with system.open_input_stream(name, compression=None) as stream:
            unpack, data = make(), stream.read(PIECE)
            while data:
                if path.endswith(".bz2"):
                    unpack.decompress(data, PIECE)
                    while not unpack.needs_input and not unpack.eof:
                        unpack.decompress(b"", PIECE)
                    rest = unpack.unused_data
                else:
                    unpack.decompress(data, PIECE)
                    while unpack.unconsumed_tail and not unpack.eof:
                        unpack.decompress(unpack.unconsumed_tail, PIECE)
                    rest = unpack.unused_data
                if unpack.eof and rest.strip(b"\0"):  # a file may be several, one after the other
                    unpack, data = make(), rest
                else:
                    data = stream.read(PIECE)
            return None if unpack.eof else "the file ends before its data"
    except Exception as error:  # zlib.error has no common base with the others
        return f"{type(error).__name__}: {error}"


def file_status(spark: SparkSession, paths) -> DataFrame:
    """``ticker, file_name, path, problem`` of every file; ``problem`` is NULL if it can be read to its end.

    Only compressed files can be damaged unnoticed. They alone are opened, by the
    tasks themselves, and unpacked in pieces of bounded size; no contents become rows.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpacked(p) for p in batch["path"].to_pylist()]
            yield batch.append_column("problem", pa.array(found, pa.string()))

    files = spark.read.format("binaryFile").load(paths)
    name = F.col("_metadata.file_name")
    files = files.select(ticker_of(name, F.col("_metadata.file_path")).alias("ticker"), name.alias("file_name"), "path")
    packed = F.col("path").rlike(r"\.(gz|bz2)$")
    # Packed files are dealt out one by one: their sizes differ and listing puts many into a task.
    checked = files.filter(packed).repartition("path").mapInArrow(check, "ticker string, file_name string, path string, problem string")
    return files.filter(~packed).withColumn("problem", F.lit(None).cast("string")).unionAll(checked)


def latest_files(bars: DataFrame) -> DataFrame:
    """Only the rows of the newest file of each ticker, by file name."""
    newest = bars.groupBy("ticker").agg(F.max("file_name").alias("file_name"))
    # A file belongs to one ticker; its name spreads the join better.
    return bars.join(newest, ["file_name", "ticker"], "left_semi")


def newest_paths(spark: SparkSession, folder: str) -> list[str]:
    """Path of the newest file of each ticker, or of its folder in a table; lists files, reads none.

    One path per ticker comes to the driver, which is what a reader takes; for
    more tickers than that use :func:`latest_files`.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv*")
        .load(folder)
        .select("path", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("_escaped"))
        .withColumn("ticker", ticker_of(F.col("file_name"), F.col("_escaped")))
        .filter(F.col("ticker") != UNKNOWN)
    )
    named = F.col("file_name").rlike(FILE_NAME)
    files = files.withColumn("path", F.when(named, F.col("path")).otherwise(F.regexp_extract("path", FOLDER, 1)))
    newest = files.groupBy("ticker").agg(F.max_by("path", "file_name").alias("path"))
    return [row["path"] for row in newest.orderBy("ticker").collect()]


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per ticker, readable with partition pruning; as CSV also by ``read_bars_csv``.

    Rows of a ticker are brought together first, so a folder gets few files;
    those of a very large ticker are split again.
    """
    bars.hint("rebalance", "ticker").write.partitionBy("ticker").mode(mode).format(fmt).options(header=True).save(path)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(BAR_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return coerce_bars(reader.load(path)).select(*BAR_SCHEMA.names)
