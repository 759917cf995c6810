import pytest
from pyspark.sql import functions as F

from barloom.functions.ema import add_ema
from barloom.functions.indicators import FEATURE_COLS
from barloom.operators.features import add_absent, compute_features, latest_features
from barloom.operators.panel import chunk_panel, index_bars

from helpers import bars_frame, close_to, ema, feature_rows, walk


def collect(df):
    return sorted(df.collect(), key=lambda r: (r["ticker"], r["date"]))


def assert_matches(rows, got):
    expected = feature_rows(rows)
    assert len(expected) == len(got)
    for want, have in zip(expected, got):
        for c in FEATURE_COLS:
            assert close_to(want[c], have[c]), (have["date"], c, want[c], have[c])


def test_all_features_bar_by_bar(spark):
    a, b = walk("A", 60, seed=3), walk("B", 45, seed=4, start=5000.0)
    # A missing High is kept; zero volume and a flat stretch are legal.
    a[20] = (*a[20][:3], None, *a[20][4:])
    b[:12] = [(r[0], r[1], 5000.0, 5000.0, 5000.0, 5000.0, 0.0) for r in b[:12]]
    got = collect(compute_features(bars_frame(spark, a + b)))
    assert_matches(a, [r for r in got if r["ticker"] == "A"])
    assert_matches(b, [r for r in got if r["ticker"] == "B"])


def test_label_and_last_row(spark):
    rows = walk("A", 30, seed=9)
    got = collect(compute_features(bars_frame(spark, rows), ()))
    close = [r[5] for r in rows]
    for i in range(29):
        change = close[i + 1] / close[i] - 1
        assert got[i]["target"] == int(change > 0.005)
        assert close_to(got[i]["next_pct_change"], change, 1e-12)
    assert got[29]["target"] == 0 and got[29]["next_pct_change"] is None
    assert compute_features(bars_frame(spark, rows), (), drop_unlabeled=True).count() == 29


def test_threshold_is_a_parameter(spark):
    rows = walk("A", 30, seed=9)
    up = compute_features(bars_frame(spark, rows), (), threshold=0.0).agg(F.sum("target")).first()[0]
    assert up == sum(b[5] > a[5] for a, b in zip(rows, rows[1:]))


def test_no_look_ahead(spark):
    rows = walk("A", 80, seed=5)
    whole = collect(compute_features(bars_frame(spark, rows)))
    part = collect(compute_features(bars_frame(spark, rows[:50])))
    for a, b in zip(part, whole):
        assert all(close_to(a[c], b[c], 1e-12) for c in FEATURE_COLS)


def test_ramp_has_all_columns_and_no_gaps(spark):
    ramp = spark.range(100).selectExpr(
        "'R' ticker", "date_add(date'2020-01-01', cast(id as int)) date", "100D + id Open",
        "101D + id High", "99D + id Low", "100D + id Close", "1000000D Volume",
    )
    df = compute_features(ramp).select(*FEATURE_COLS)
    assert df.count() == 100 and len(df.columns) == 39
    assert df.filter(" or ".join(f"{c} is null" for c in FEATURE_COLS)).count() == 0
    assert all(kind == "double" for _, kind in df.dtypes)


def test_rsi_stays_in_range(spark):
    df = compute_features(bars_frame(spark, walk("A", 200, seed=8)), ("rsi",))
    low, high = df.agg(F.min("rsi"), F.max("rsi")).first()
    assert 0 <= low and high <= 100


@pytest.mark.parametrize("n,kept", [(25, 0), (26, 26), (0, 0)])
def test_history_gate(spark, n, kept):
    assert compute_features(bars_frame(spark, walk("A", n))).count() == kept


def test_raw_gate_counts_rows_before_cleaning(spark):
    rows = walk("A", 50, seed=2)
    rows[10] = (*rows[10][:5], None, rows[10][6])
    bars = bars_frame(spark, rows)
    assert compute_features(bars, (), min_raw=50).count() == 49
    assert compute_features(bars, (), min_raw=51).count() == 0


def test_zero_price_gives_zero_not_infinity(spark):
    rows = walk("A", 40, seed=2)
    rows[15] = (*rows[15][:2], 0.0, 0.0, 0.0, 0.0, 10.0)
    got = collect(compute_features(bars_frame(spark, rows)))
    assert_matches(rows, got)


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="lacks the columns"):
        compute_features(bars_frame(spark, walk("A", 30)).drop("High"))


def test_absent_feature_columns_are_zero(spark):
    assert add_absent(spark.range(1), ["id", "x"]).first()["x"] == 0.0


def test_latest_rows_equal_the_full_computation(spark):
    rows = walk("A", 1700, seed=6) + walk("B", 40, seed=7)
    bars = bars_frame(spark, rows)
    full = collect(compute_features(bars))
    tail = collect(latest_features(bars, 3))
    wanted = [r for r in full if r["idx"] >= r["n_bars"] - 3]
    assert [(r["ticker"], r["date"]) for r in tail] == [(r["ticker"], r["date"]) for r in wanted]
    for a, b in zip(tail, wanted):
        assert all(close_to(a[c], b[c], 1e-11) for c in FEATURE_COLS)


@pytest.mark.parametrize("span", [2, 5, 26])
def test_average_over_many_blocks(spark, span):
    rows = walk("A", 2600, seed=1)
    bars = index_bars(bars_frame(spark, rows))
    panel = add_ema(chunk_panel(bars, before=512, chunk_rows=512), "Close", span, "e")
    got = [r["e"] for r in panel.result().orderBy("date").collect()]
    want = ema([r[5] for r in rows], span)
    assert max(abs(a - b) / b for a, b in zip(got, want)) < 1e-12


@pytest.mark.parametrize("bad", [1, 200])
def test_average_refuses_spans_its_blocks_cannot_hold(spark, bad):
    panel = chunk_panel(index_bars(bars_frame(spark, walk("A", 30))))
    with pytest.raises(ValueError, match="span"):
        add_ema(panel, "Close", bad, "e")
