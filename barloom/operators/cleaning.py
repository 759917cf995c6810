"""Normalising, cleaning and checking raw bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions.maths import missing_to_null
from barloom.operators.panel import index_bars

PRICE_COLS = ("Open", "High", "Low", "Close")
NUMERIC_COLS = (*PRICE_COLS, "Volume")
EXCHANGE_ZONE = "America/New_York"


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")


def normalize_bars(raw: DataFrame, zone: str = EXCHANGE_ZONE, intraday: bool = False) -> DataFrame:
    """Rename ``Date``, parse it, and derive the trading day.

    Text may mix UTC offsets: it is parsed to an instant and the day is taken
    in the zone of the exchange.  Text without an offset is local already.
    With ``intraday`` the instant is kept.  No global sort: order lives in the
    windows that need it.
    """
    if "date" not in raw.columns and "Date" in raw.columns:
        raw = raw.withColumnRenamed("Date", "date")
    kind = raw.schema["date"].dataType
    date = F.col("date")
    session = raw.sparkSession.conf.get("spark.sql.session.timeZone")

    def local_day(instant: Column) -> Column:
        wall = instant.cast("timestamp_ntz")
        return F.convert_timezone(F.lit(session), F.lit(zone), wall).cast("date")

    if isinstance(kind, T.StringType):
        instant = F.expr("try_cast(date AS timestamp)")
        zoned = date.rlike(r":\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
        plain_day = F.expr("try_cast(date AS date)")
        value = instant if intraday else F.when(zoned, local_day(instant)).otherwise(plain_day)
    elif isinstance(kind, T.TimestampType) and not intraday:
        value = local_day(date)
    elif isinstance(kind, T.TimestampNTZType) and not intraday:
        value = date.cast("date")
    else:
        value = date
    return coerce_bars(raw.withColumn("date", value))


def coerce_bars(raw: DataFrame) -> DataFrame:
    """Numbers as double; text that is no number, and NaN, become NULL."""
    return raw.withColumns(
        {c: missing_to_null(F.expr(f"try_cast(`{c}` AS double)")) for c in NUMERIC_COLS}
    )


def nan_to_null(bars: DataFrame) -> DataFrame:
    """NaN prices and volumes become NULL."""
    numeric = {c for c, kind in bars.dtypes if kind in ("double", "float")}
    return bars.withColumns({c: missing_to_null(F.col(c)) for c in NUMERIC_COLS if c in numeric})


def usable() -> Column:
    """Rows with Close and Volume; other prices may be missing."""
    return F.col("Close").isNotNull() & F.col("Volume").isNotNull()


def clean_bars(bars: DataFrame) -> DataFrame:
    """Drop rows without Close or Volume."""
    return nan_to_null(bars).filter(usable())


def dedupe_bars(bars: DataFrame, newest: Column, by=("ticker",), order: str = "date") -> DataFrame:
    """One row per ``(by, order)``: the one with the largest ``newest``.

    A grouped aggregate, so copies are reduced before the shuffle and a key
    with very many copies never lands in one sort.
    """
    values = [c for c in bars.columns if c not in (*by, order)]
    kept = F.max_by(F.struct(*values), newest).alias("_kept")
    return bars.groupBy(*by, order).agg(kept).select(*by, order, "_kept.*").select(*bars.columns)


def date_range(bars: DataFrame, start=None, end=None, order: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both days included."""
    day = F.col(order)
    if start is not None:
        bars = bars.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        # Compared as "before the next day" so that bars stamped during the
        # last day stay in, and so that the filter reaches the scan.
        bars = bars.filter(day < F.date_add(F.lit(end).cast("date"), 1))
    return bars


def half_open_range(bars: DataFrame, start=None, end=None, order: str = "date") -> DataFrame:
    """Rows from ``start`` up to but not including ``end``, as providers cut."""
    if start is not None:
        bars = bars.filter(F.col(order) >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col(order) < F.lit(end).cast("date"))
    return bars


def look_back_range(bars: DataFrame, months: int = 24, as_of=None, order: str = "date") -> DataFrame:
    """The last ``months`` months before ``as_of`` (default: the newest bar)."""
    if as_of is not None:
        until = F.lit(as_of).cast("date")
        return bars.filter((F.col(order) >= F.add_months(until, -months)) & (F.col(order) < until))
    newest = bars.agg(F.max(order).cast("date").alias("newest")).scalar()
    return bars.filter(F.col(order) >= F.add_months(newest, -months))


def min_history(bars: DataFrame, rows: int = 26, by=("ticker",), order: str = "date") -> DataFrame:
    """Series with at least ``rows`` bars, with their length ``n_bars``."""
    return index_bars(bars, by, order, min_rows=rows)


def validate_bars(
    bars: DataFrame, rows: int = 26, by=("ticker",), order: str = "date"
) -> DataFrame:
    """Per series: can it be scored, and if not, the first reason why.

    Rows whose date is missing or did not parse are counted: they have no place
    in a series, and the operators behind leave them out.
    """
    require_columns(bars, [*by, order, *NUMERIC_COLS])
    gap = F.col("Close").isNull() | F.col("Volume").isNull()
    counts = bars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(gap).alias("n_missing"),
        F.count_if(F.col(order).isNull()).alias("n_bad_dates"),
    )

    def counted(name: str, text: str) -> Column:
        return F.concat(F.col(name).cast("string"), F.lit(text))

    message = (
        F.when(F.col("n_rows") < rows, counted("n_rows", f" bars, {rows} are needed"))
        .when(F.col("n_bad_dates") > 0, counted("n_bad_dates", " bars have no valid date"))
        .when(F.col("n_missing") > 0, counted("n_missing", " bars lack a close or a volume"))
        .otherwise("")
    )
    return counts.withColumn("error_message", message).withColumn(
        "is_valid", F.col("error_message") == ""
    )
