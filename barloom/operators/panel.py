"""Row positions and bounded window groups for long, skewed series.

The obvious window for a time series is ``partitionBy("ticker")``.  It sends a
whole ticker to one task, so a ticker that holds a third of all rows makes one
task do a third of the work.  Two steps avoid that, without dropping a row:

``index_bars``
    gives each row its 0-based position ``idx`` in its series and the length
    ``n_bars`` of the series.  Rows are numbered inside ``(ticker, time
    bucket)``; the offset of each bucket comes from a running sum over the
    bucket counts, a table with one row per bucket instead of one per bar.

``chunk_panel``
    cuts every series into chunks of ``CHUNK_ROWS`` consecutive rows and copies
    the last ``before`` rows of a chunk into the next one (and the first
    ``after`` rows into the previous one).  All window frames then run inside
    ``(ticker, chunk)``, which is bounded whatever the length of the series;
    the copies, marked ``core = false``, are dropped at the end.

Functions whose value depends on the whole past (running products and maxima)
add a third step: one row of totals per chunk, a running aggregate over those
rows, and a join back on ``(ticker, chunk)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.window import WindowSpec

from barloom.session import cut_lineage

# An exponential average is computed in blocks of this many rows; what a row
# more than one whole block back contributes is below double precision.
BLOCK_ROWS = 512
CHUNK_ROWS = 64 * BLOCK_ROWS

# Days per numbering bucket.  With one row per (ticker, date) a bucket holds at
# most 4096 daily bars, or 604,800 one-second bars.
DATE_BUCKET_DAYS = 4096
TIMESTAMP_BUCKET_DAYS = 7

LAYOUT = ("idx", "n_bars", "chunk")

# Metadata of the column ``chunk``: the number of rows in one.
CHUNK_SIZE = "barloom.rows"


def _bucket(df: DataFrame, order: str, days: int | None) -> Column:
    # The calendar day grows with the row order for dates and both kinds of
    # timestamp, which is all that numbering needs.
    if days is None:
        is_date = isinstance(df.schema[order].dataType, T.DateType)
        days = DATE_BUCKET_DAYS if is_date else TIMESTAMP_BUCKET_DAYS
    bucket = F.floor(F.unix_date(F.col(order).cast("date")) / F.lit(days))
    # Never NULL, so that no join adds a filter to one reader of the bars only:
    # two readers with the same columns then share one exchange.
    return F.coalesce(bucket, F.lit(0).cast("bigint"))


def series_spine(
    bars: DataFrame,
    by: tuple[str, ...] = ("ticker",),
    order: str = "date",
    bucket_days: int | None = None,
    valid: Column | None = None,
) -> DataFrame:
    """One row per series and time bucket.

    ``_base`` counts the valid rows before the bucket, ``n_bars`` the valid
    rows of the series and ``n_raw`` all of its rows.
    """
    counted = F.count(F.lit(1))
    counts = (
        bars.withColumn("_bucket", _bucket(bars, order, bucket_days))
        .groupBy(*by, "_bucket")
        .agg((counted if valid is None else F.count_if(valid)).alias("_rows"), counted.alias("_raw"))
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
        "_rows",
        F.sum("_rows").over(whole).alias("n_bars"),
        F.sum("_raw").over(whole).alias("n_raw"),
    )


def index_bars(
    bars: DataFrame,
    by: tuple[str, ...] = ("ticker",),
    order: str = "date",
    bucket_days: int | None = None,
    valid: Column | None = None,
    min_rows: int = 0,
    min_raw: int = 0,
    tail: int | None = None,
) -> DataFrame:
    """Add ``idx`` (position in the series) and ``n_bars`` (its length).

    Rows that are not ``valid`` are left out, and so are series with fewer than
    ``min_rows`` valid rows or fewer than ``min_raw`` rows of any kind.  Rows
    without a key or a date have no place in a series and are left out too.
    With ``tail`` only the time buckets that hold the last ``tail`` rows of a
    series are read on; their rows keep the positions they have in the whole.
    ``(by, order)`` must be unique.
    """
    bars = bars.drop("idx", "n_bars", "chunk")
    for key in (*by, order):
        bars = bars.filter(F.col(key).isNotNull())
    spine = series_spine(bars, by, order, bucket_days, valid)
    spine = spine.filter((F.col("n_bars") >= min_rows) & (F.col("n_raw") >= min_raw))
    if tail is not None:
        spine = spine.filter(F.col("_base") + F.col("_rows") > F.col("n_bars") - F.lit(tail))
    rows = bars if valid is None else bars.filter(valid)
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(order)
    return (
        rows.withColumn("_bucket", _bucket(bars, order, bucket_days))
        .join(spine, keys)
        .withColumn("idx", F.col("_base") + F.row_number().over(inside) - F.lit(1))
        .drop("_bucket", "_base", "_rows", "n_raw")
    )


def index_bars_once(
    bars: DataFrame,
    by: tuple[str, ...] = ("ticker",),
    order: str = "date",
    valid: Column | None = None,
    min_rows: int = 0,
    min_raw: int = 0,
) -> DataFrame:
    """The rows of ``index_bars``, with ``bars`` computed once.

    Rows are dealt out by ranges of (series, valid first, order), sorted, and
    written. A row's place among those of its task is kept with it; what a
    series has in a file follows from the least place and the number of rows,
    and positions from a running sum over its files. A long series lies in many
    files, and rows meet the table of files by (series, file).
    """
    bars = bars.drop("idx", "n_bars", "chunk")
    for key in (*by, order):
        bars = bars.filter(F.col(key).isNotNull())
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    bars = bars.withColumn("_left_out", ~ok)
    keys = [*by, "_left_out", order]
    dealt = bars.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut_lineage(dealt.withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumn("_file", F.expr("shiftright(_place, 33)"))
    files = rows.groupBy(*by, "_file").agg(
        F.count_if(~F.col("_left_out")).alias("_rows"),
        F.count(F.lit(1)).alias("_raw"),
        F.min(F.when(~F.col("_left_out"), F.col("_place"))).alias("_first"),
    )
    whole = Window.partitionBy(*by)  # one row per file of the series
    earlier = whole.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        *by,
        "_file",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n_bars"),
        F.sum("_raw").over(whole).alias("_n_raw"),
    )
    files = files.filter((F.col("n_bars") >= min_rows) & (F.col("_n_raw") >= min_raw))
    return (
        rows.filter(~F.col("_left_out"))
        .join(files, [*by, "_file"])
        .withColumn("idx", F.col("_place") + F.col("_shift"))
        .drop("_file", "_place", "_shift", "_n_raw", "_left_out")
    )


def block_rows_for(span: int) -> int:
    """Smallest usable block for an exponential average of this span."""
    q = 1.0 - 2.0 / (span + 1.0)
    if q <= 0.0:
        return 1
    return math.ceil(math.log(1e-17) / math.log(q))


@dataclass(frozen=True)
class Panel:
    """Bars laid out in groups small enough for one task.

    ``df`` holds ``idx`` and ``blk`` (block number of the row) and ``core``
    (false for the rows copied from a neighbouring chunk).
    """

    df: DataFrame
    by: tuple[str, ...]
    chunked: bool
    block: int = BLOCK_ROWS

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.by, "chunk") if self.chunked else self.by

    def row(self) -> WindowSpec:
        """Window for lag and lead."""
        return Window.partitionBy(*self.keys).orderBy("blk", "idx")

    def last(self, n: int) -> WindowSpec:
        """The current row and up to ``n - 1`` rows before it."""
        return self.row().rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.row().rowsBetween(Window.unboundedPreceding, 0)

    # The same windows as SQL text, for plans with many columns: parsing one
    # string is far cheaper than building its tree call by call.

    def _over(self, frame: str = "", order: str = "blk, idx", extra: str = "") -> str:
        keys = ", ".join(f"`{k}`" for k in self.keys) + extra
        return f"(PARTITION BY {keys} ORDER BY {order} {frame})"

    def row_sql(self) -> str:
        return self._over()

    def last_sql(self, n: int) -> str:
        return self._over(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")

    def in_block_sql(self) -> str:
        return self._over("ROWS UNBOUNDED PRECEDING", "idx", ", blk")

    def previous_block_sql(self) -> str:
        return self._over("RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING", "blk")

    def with_df(self, df: DataFrame) -> "Panel":
        return replace(self, df=df)

    def add(self, columns: dict[str, Column]) -> "Panel":
        return self.with_df(self.df.withColumns(columns))

    def add_sql(self, columns: dict[str, str]) -> "Panel":
        texts = [f"{text} AS `{name}`" for name, text in columns.items()]
        return self.with_df(self.df.selectExpr("*", *texts))

    def split_by(self, name: str) -> "Panel":
        """Treat every value of one more column as a series of its own."""
        return replace(self, by=(*self.by, name))

    def core(self) -> "Panel":
        """Without the copied rows."""
        return self.with_df(self.df.filter("core"))

    def result(self) -> DataFrame:
        return self.core().df.drop("blk", "core")


def _ordered(df: DataFrame, keys: tuple[str, ...], order: str | None = None) -> DataFrame:
    # One exchange and one sort serve every window of the panel.  The number of
    # partitions is given: the windows cost far more time than their input has
    # bytes, and adaptive execution would merge small partitions by bytes.
    # ``idx`` is unique, so ``order`` behind it never decides; the sort needs the
    # column, though, and so it stays for a reader that has no other use for it.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = () if order is None else (order,)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, "blk", "idx", *last)


def chunk_panel(
    indexed: DataFrame,
    by: tuple[str, ...] = ("ticker",),
    before: int = 0,
    after: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    block: int = BLOCK_ROWS,
    order: str | None = None,
) -> Panel:
    """Cut indexed series into chunks that see ``before``/``after`` more rows.

    With ``order`` that column reaches every reader of the panel: one of the rows
    and one of totals per chunk then ask for the same columns and share one
    exchange, so that what stands behind it is computed once.
    """
    if chunk_rows % block:
        raise ValueError(f"chunk_rows={chunk_rows} must be a multiple of {block}")
    first = F.expr(f"greatest(idx - {after}, 0L) div {chunk_rows}L")
    last = F.expr(f"least(idx + {before}, n_bars - 1L) div {chunk_rows}L")
    df = (
        indexed.drop("chunk")
        .withColumn("chunk", F.explode(F.sequence(first, last)))
        .withMetadata("chunk", {CHUNK_SIZE: chunk_rows})
        .withColumn("core", F.expr(f"idx div {chunk_rows}L = chunk"))
        .withColumn("blk", F.expr(f"idx div {block}L"))
    )
    return Panel(_ordered(df, (*by, "chunk"), order), by, True, block)


def tail_panel(
    indexed: DataFrame,
    by: tuple[str, ...] = ("ticker",),
    rows: int = 1,
    before: int = 0,
    block: int = BLOCK_ROWS,
) -> Panel:
    """Only the last ``rows`` rows of each series and what they look back on.

    The rest is filtered out before the exchange, so scoring the latest bar
    costs the same for a long and a short series.
    """
    df = (
        indexed.filter(F.col("idx") >= F.col("n_bars") - F.lit(rows + before))
        .withColumn("core", F.col("idx") >= F.col("n_bars") - F.lit(rows))
        .withColumn("blk", F.expr(f"idx div {block}L"))
    )
    return Panel(_ordered(df, by), by, False, block)


def group_panel(df: DataFrame, by: tuple[str, ...], block: int = BLOCK_ROWS) -> Panel:
    """Groups that are bounded already and carry their own ``idx``.

    Rows that a window over ``by`` has brought together are not moved again.
    """
    df = df.withColumn("core", F.lit(True)).withColumn("blk", F.expr(f"idx div {block}L"))
    return Panel(df.sortWithinPartitions(*by, "blk", "idx"), by, False, block)


def attach_stats(
    rows: DataFrame,
    stats: DataFrame,
    by: tuple[str, ...] = ("ticker",),
    how: str = "inner",
    extra: tuple[str, ...] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Join per-series statistics back to indexed rows.

    The join key is ``(by, extra, chunk)``, not ``by``: the statistics are
    repeated once per chunk of the series, so a hot ticker is spread over as
    many tasks as it has chunks.  ``stats`` must hold ``n_bars``.  A ``chunk``
    that says how many rows it has (``chunk_panel`` notes it) is used as it is;
    beside any other, chunks of ``chunk_rows`` are counted from ``idx``.
    """
    key = "chunk"
    if key in rows.columns:
        size = rows.schema[key].metadata.get(CHUNK_SIZE)
        key, chunk_rows = (key, size) if size else ("_piece", chunk_rows)
    if key not in rows.columns:
        rows = rows.withColumn(key, F.expr(f"idx div {chunk_rows}L"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_bars - 1L) div {chunk_rows}L"))
    spread = stats.withColumn(key, F.explode(pieces)).drop("n_bars")
    return rows.join(spread, [*by, *extra, key], how).drop("_piece")
