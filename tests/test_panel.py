import pytest
from pyspark.sql import functions as F

from barloom.operators.features import compute_features
from barloom.operators.panel import (
    attach_stats,
    chunk_panel,
    index_bars,
    index_bars_once,
    series_spine,
    tail_panel,
)

from barloom.sources.ticks import bars_from_ticks

from helpers import bars_frame, close_to, walk


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with most of the rows, a few short ones."""
    rows = walk("HOT", 3000, seed=7)
    for k in range(4):
        rows += walk(f"T{k}", 20 + k, seed=k, gap_days=3)
    return bars_frame(spark, rows).cache()


def test_index_is_the_row_number_in_the_series(skewed):
    got = index_bars(skewed, bucket_days=10).select("ticker", "date", "idx", "n_bars").collect()
    assert len(got) == skewed.count()
    series = {}
    for row in got:
        series.setdefault(row["ticker"], []).append(row)
    for rows in series.values():
        rows.sort(key=lambda r: r["date"])
        assert [r["idx"] for r in rows] == list(range(len(rows)))
        assert {r["n_bars"] for r in rows} == {len(rows)}


@pytest.mark.parametrize("gates", [{}, {"min_rows": 22}, {"min_raw": 23}])
def test_numbering_in_one_reading(spark, skewed, gates):
    holes = skewed.withColumn("Close", F.when(F.dayofmonth("date") != 5, F.col("Close")))
    holes = holes.unionByName(holes.limit(3).withColumn("ticker", F.lit(None).cast("string")))
    valid = F.col("Close").isNotNull()
    want = index_bars(holes, valid=valid, **gates).drop("chunk")
    got = index_bars_once(holes, valid=valid, **gates)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert index_bars_once(skewed.limit(0)).count() == 0


def test_bars_are_computed_once(spark, tmp_path):
    """Ticks are counted as tasks read them: by one reading, whoever needs the bars."""
    spark.range(5000).selectExpr("id", "concat('T', id % 3) AS t", "timestampadd(HOUR, id, timestamp_ntz'2024-01-01') AS ts", "100D + id % 17 AS p").write.parquet(str(tmp_path / "ticks"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ticks = spark.read.parquet(str(tmp_path / "ticks"))
    ticks = ticks.mapInArrow(seen, ticks.schema)
    bars = bars_from_ticks(ticks, F.col("t"), F.col("ts"), F.col("p"), F.lit(1.0), ["ts", "id"], "1h")
    assert compute_features(bars, ("sma_5",), once=True).count() == 5000
    assert read.value == 5000


def test_spine_is_much_smaller_than_the_series(skewed):
    spine = series_spine(skewed, bucket_days=100)
    assert spine.filter("ticker = 'HOT'").count() <= 31


def test_chunks_are_bounded_and_keep_every_row_once(skewed):
    indexed = index_bars(skewed)
    panel = chunk_panel(indexed, before=30, after=1, chunk_rows=512)
    sizes = panel.df.groupBy("ticker", "chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= 512 + 30 + 1
    core = panel.core().df
    assert core.count() == skewed.count()
    assert core.select("ticker", "date").distinct().count() == skewed.count()


def test_halo_longer_than_a_chunk(skewed):
    panel = chunk_panel(index_bars(skewed), before=1200, chunk_rows=512)
    rows = panel.df.filter("ticker = 'HOT' and chunk = 4").agg(F.min("idx"), F.max("idx")).first()
    assert tuple(rows) == (4 * 512 - 1200, 5 * 512 - 1)


def test_chunk_rows_must_hold_whole_blocks(skewed):
    with pytest.raises(ValueError):
        chunk_panel(index_bars(skewed), chunk_rows=500)


def test_features_do_not_depend_on_the_chunk_size(skewed):
    columns = ("sma_20", "rsi", "macd_signal", "adx", "volatility_20", "trend_strength")
    small = compute_features(skewed, columns, min_rows=1, chunk_rows=512)
    large = compute_features(skewed, columns, min_rows=1)
    key = lambda r: (r["ticker"], r["date"])
    keep = ("ticker", "date", *columns, "target")
    a = sorted(small.select(*keep).collect(), key=key)
    b = sorted(large.select(*keep).collect(), key=key)
    assert len(a) == len(b) == skewed.count()
    for x, y in zip(a, b):
        assert key(x) == key(y) and x["target"] == y["target"]
        assert all(close_to(x[c], y[c], 1e-12) for c in columns)


def test_tail_panel_keeps_only_the_look_back(skewed):
    panel = tail_panel(index_bars(skewed), rows=2, before=10)
    assert panel.df.filter("ticker = 'HOT'").count() == 12
    assert panel.core().df.groupBy("ticker").count().filter("count <> 2").count() == 0


def test_statistics_come_back_by_chunk(skewed):
    indexed = index_bars(skewed)
    stats = indexed.groupBy("ticker").agg(F.max("Close").alias("top"), F.max("n_bars").alias("n_bars"))
    joined = attach_stats(indexed, stats, chunk_rows=512)
    assert joined.count() == skewed.count()
    assert joined.filter("Close > top").count() == 0


@pytest.mark.parametrize("noted", [True, False])
def test_statistics_meet_chunks_of_any_size(skewed, noted):
    """Chunks of 512 rows keep all rows, also where a table has lost the note of their size."""
    rows = chunk_panel(index_bars(skewed), chunk_rows=512).result()
    if not noted:
        rows = rows.withMetadata("chunk", {})
    stats = rows.groupBy("ticker").agg(F.max("Close").alias("top"), F.max("n_bars").alias("n_bars"))
    joined = attach_stats(rows, stats)
    assert joined.count() == skewed.count() and set(joined.columns) == {*rows.columns, "top"}
    assert joined.filter("Close > top").count() == 0


def test_scaling_keeps_the_rows_of_small_chunks(skewed):
    from barloom.operators.training_set import scale_features, time_split

    scaled = [
        scale_features(time_split(compute_features(skewed, ("pct_change_1",), min_rows=1, chunk_rows=n)), ("pct_change_1",))
        .select("ticker", "date", F.round("pct_change_1", 9).alias("x"))
        for n in (512, 32768)
    ]
    assert scaled[0].count() == skewed.count()
    assert scaled[0].exceptAll(scaled[1]).count() == 0
