"""Feature matrix and label for a panel of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.indicators import (
    FEATURE_COLS,
    RSI_PERIOD,
    TARGET_THRESHOLD,
    add_indicators,
    add_target,
    look_back,
    uses_average,
)
from barloom.operators.cleaning import nan_to_null, require_columns, usable
from barloom.operators.panel import (
    BLOCK_ROWS,
    CHUNK_ROWS,
    LAYOUT,
    Panel,
    chunk_panel,
    index_bars,
    index_bars_once,
    tail_panel,
)

MIN_ROWS = 26
LABEL_COLS = ("next_close", "next_pct_change", "target")


def add_absent(df: DataFrame, columns) -> DataFrame:
    """Create the columns the frame lacks, filled with 0."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def fill_features(df: DataFrame, columns) -> DataFrame:
    """Cast feature columns to double and put 0 where a value is missing."""
    wanted = set(columns)
    return df.selectExpr(
        *[
            f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS `{c}`" if c in wanted else f"`{c}`"
            for c in df.columns
        ]
    )


def indexed_history(
    bars: DataFrame,
    by=("ticker",),
    order: str = "date",
    min_rows: int = MIN_ROWS,
    min_raw: int = 0,
    tail: int | None = None,
    bucket_days: int | None = None,
    once: bool = False,
) -> DataFrame:
    """Usable bars with positions; series that are too short are left out.

    ``min_rows`` counts usable bars, ``min_raw`` bars before cleaning.  Fewer
    ``bucket_days`` keep the numbering of very dense series in small groups.
    ``once`` is for bars that are dear to compute, such as those made from
    ticks: they are computed once and written, instead of read twice.
    """
    require_columns(bars, [*by, order, "Open", "High", "Low", "Close", "Volume"])
    if once:
        return index_bars_once(nan_to_null(bars), by, order, usable(), min_rows, min_raw)
    return index_bars(
        nan_to_null(bars),
        by,
        order,
        valid=usable(),
        min_rows=min_rows,
        min_raw=min_raw,
        tail=tail,
        bucket_days=bucket_days,
    )


def feature_panel(
    bars: DataFrame,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    order: str = "date",
    min_rows: int = MIN_ROWS,
    rsi_period: int = RSI_PERIOD,
    threshold: float = TARGET_THRESHOLD,
    spare: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    min_raw: int = 0,
    bucket_days: int | None = None,
    once: bool = False,
) -> Panel:
    """Bars with indicators and label, still in chunks.

    ``spare`` copied rows stay valid for an operator that looks back further,
    for example a strategy return that needs the signal of the previous bar.
    """
    before = look_back(columns, rsi_period)
    if spare:
        before += BLOCK_ROWS if uses_average(columns) else spare
    indexed = indexed_history(bars, by, order, min_rows, min_raw, bucket_days=bucket_days, once=once)
    panel = chunk_panel(indexed, by, before=before, after=1, chunk_rows=chunk_rows, order=order)
    return add_target(add_indicators(panel, columns, rsi_period), threshold)


def compute_features(
    bars: DataFrame,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    order: str = "date",
    min_rows: int = MIN_ROWS,
    rsi_period: int = RSI_PERIOD,
    threshold: float = TARGET_THRESHOLD,
    drop_unlabeled: bool = False,
    fill: bool = True,
    chunk_rows: int = CHUNK_ROWS,
    min_raw: int = 0,
    bucket_days: int | None = None,
    once: bool = False,
) -> DataFrame:
    """Bars plus feature columns, ``next_close``, ``next_pct_change``, ``target``.

    ``once`` computes ``bars`` once instead of twice, by writing them.  ``idx``, ``n_bars`` and ``chunk`` stay in the result: the operators
    downstream use them instead of sorting the series again.
    """
    df = feature_panel(
        bars,
        columns,
        by,
        order,
        min_rows,
        rsi_period,
        threshold,
        chunk_rows=chunk_rows,
        min_raw=min_raw,
        bucket_days=bucket_days,
        once=once,
    ).result()
    if drop_unlabeled:
        df = df.filter(F.col("next_close").isNotNull())
    return _select(df, columns, by, order, fill)


def latest_features(
    bars: DataFrame,
    rows: int = 1,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    order: str = "date",
    min_rows: int = MIN_ROWS,
    rsi_period: int = RSI_PERIOD,
    bucket_days: int | None = None,
) -> DataFrame:
    """Features of the last ``rows`` bars of every series.

    Only the look-back of those bars is shuffled and computed.
    """
    before = look_back(columns, rsi_period)
    if uses_average(columns):
        before += BLOCK_ROWS  # the last bar sits anywhere in its block
    indexed = indexed_history(
        bars, by, order, min_rows, tail=rows + before, bucket_days=bucket_days
    )
    panel = tail_panel(indexed, by, rows, before)
    panel = add_target(add_indicators(panel, columns, rsi_period))
    return _select(panel.result(), columns, by, order, fill=True)


def _select(df: DataFrame, columns, by, order: str, fill: bool) -> DataFrame:
    df = add_absent(df, columns)
    if fill:
        df = fill_features(df, columns)
    layout = [c for c in LAYOUT if c in df.columns]
    bars = ["Open", "High", "Low", "Close", "Volume"]
    extra = [c for c in columns if c not in bars]
    return df.select(*by, order, *bars, *extra, *LABEL_COLS, *layout)
