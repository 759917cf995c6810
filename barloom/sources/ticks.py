"""Bars of any interval from trade-like rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Bar intervals by name, as data providers spell them.
INTERVALS = {"1d": "day", "1h": "hour", "1m": "minute", "1wk": "week", "1mo": "month"}


def bar_time(ts: Column, interval: str) -> Column:
    """Start of the bar that ``ts`` falls into."""
    unit = INTERVALS.get(interval, interval)
    if unit == "day":
        return ts.cast("date")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def packed_order(ticks: DataFrame, sequence: dict[str, int] | list[str]) -> Column:
    """The columns of ``sequence`` as one DECIMAL(38) that orders like them.

    Dates and times count in days and microseconds.  A dictionary gives the
    digits of each column; a list shares 38 digits out, 17 to a time.  A value
    that needs more digits, has a fraction, or is negative after the first
    column is an error in every mode of Spark, never a wrong order.  A missing
    value orders as 0.
    """
    kinds = {name: ticks.schema[name].dataType for name in sequence}
    times = (T.TimestampType, T.TimestampNTZType)
    if not isinstance(sequence, dict):
        stamps = sum(isinstance(k, times) for k in kinds.values())
        others = max(1, len(kinds) - stamps)
        share = (38 - 17 * stamps) // others
        sequence = {n: 17 if isinstance(k, times) else share for n, k in kinds.items()}
    if not 0 < sum(sequence.values()) <= 38 or min(sequence.values()) < 1:
        raise ValueError(f"an order has 1 to 38 digits in all, not {sequence}")
    total, left = None, sum(sequence.values())
    for name, digits in sequence.items():
        left -= digits
        value = f"`{name}`"
        if isinstance(kinds[name], T.TimestampType):
            value = f"unix_micros({value})"
        elif isinstance(kinds[name], T.TimestampNTZType):
            value = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {value})"
        elif isinstance(kinds[name], T.DateType):
            value = f"unix_date({value})"
        elif not isinstance(kinds[name], (T.IntegralType, T.DecimalType, T.FractionalType)):
            raise ValueError(f"column {name} is neither a number nor a time")
        unit = f"CAST('1{'0' * left}' AS DECIMAL({left + 1}, 0))"
        cast = f"try_cast({value} AS DECIMAL({digits}, 0))"
        wrong = f"{cast} IS NULL OR {cast} <> {value}"
        if total is not None:
            wrong += f" OR {cast} < 0"
        message = f"a value of {name} does not fit into {digits} digits of an order"
        error = f"CAST(raise_error('{message}') AS DECIMAL({digits}, 0))"
        part = f"CAST(CASE WHEN {value} IS NULL THEN 0 WHEN {wrong} THEN {error} ELSE {cast} END AS DECIMAL({digits}, 0)) * {unit}"
        total = part if total is None else f"CAST({total} AS DECIMAL(38, 0)) + {part}"
    return F.expr(f"CAST({total} AS DECIMAL(38, 0))")


def bars_from_ticks(
    ticks: DataFrame,
    ticker: Column,
    ts: Column,
    price: Column,
    size: Column,
    sequence: dict[str, int] | list[str],
    interval: str = "1d",
) -> DataFrame:
    """Open, High, Low, Close and Volume per ticker and interval.

    ``sequence`` names the columns that order the ticks, which must tell the
    ticks of a bar apart (see :func:`packed_order`).  One grouped aggregate with
    partial results on the map side: ticks of a hot ticker are reduced to bars
    before the shuffle.  All buffers have a fixed width, so the aggregate hashes
    and no tick is sorted.
    """
    order = packed_order(ticks, sequence)
    rows = ticks.select(
        ticker.alias("ticker"),
        bar_time(ts, interval).alias("date"),
        price.cast("double").alias("_price"),
        size.cast("double").alias("_size"),
        order.alias("_order"),
    )
    return rows.groupBy("ticker", "date").agg(
        F.min_by("_price", "_order").alias("Open"),
        F.max("_price").alias("High"),
        F.min("_price").alias("Low"),
        F.max_by("_price", "_order").alias("Close"),
        F.sum("_size").alias("Volume"),
    )
