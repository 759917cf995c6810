from pyspark.sql import functions as F

from barloom.operators import walkforward as wf
from barloom.operators.panel import index_bars

from helpers import bars_frame, close_to, mean, walk, window
from test_backtest import simulate


def loop_windows(n, train, test, step):
    out, start = [], 0
    while start + train + test <= n:
        out.append((start, start + train, start + train + test))
        start += step
    return out


def test_windows_equal_a_loop(spark):
    rows = walk("A", 500) + walk("B", 314) + walk("C", 315)
    indexed = index_bars(bars_frame(spark, rows))
    got = {}
    for r in wf.walk_forward_windows(indexed).select("ticker", "window_id", "idx").collect():
        got.setdefault((r["ticker"], r["window_id"]), []).append(r["idx"])
    want = {}
    for ticker, n in (("A", 500), ("B", 314), ("C", 315)):
        for k, (_, a, b) in enumerate(loop_windows(n, 252, 63, 21)):
            want[(ticker, k)] = list(range(a, b))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_step_longer_than_the_test_window(spark):
    indexed = index_bars(bars_frame(spark, walk("A", 300)))
    got = wf.walk_forward_windows(indexed, 50, 20, 45)
    want = sum(b - a for _, a, b in loop_windows(300, 50, 20, 45))
    assert got.count() == want


def test_bounds(spark):
    bars = walk("A", 400)
    indexed = index_bars(bars_frame(spark, bars))
    got = wf.window_bounds(indexed, train=100, test=40, step=30).orderBy("window_id").collect()
    want = loop_windows(400, 100, 40, 30)
    assert len(got) == len(want)
    for row, (s, t, e) in zip(got, want):
        assert row["train_start"] == bars[s][1] and row["train_end"] == bars[t - 1][1]
        assert row["test_start"] == bars[t][1] and row["test_end"] == bars[e - 1][1]
        assert row["train_end"] < row["test_start"]


def test_rule_is_evaluated_on_fresh_slices(spark):
    bars = walk("A", 420, seed=21)
    bars[300] = (*bars[300][:5], None, bars[300][6])
    got = wf.walk_forward_rule(bars_frame(spark, bars)).orderBy("window_id").collect()
    want = loop_windows(420, 252, 63, 21)
    assert len(got) == len(want)
    for row, (_, a, b) in zip(got, want):
        close = [r[5] for r in bars[a:b] if r[5] is not None]
        position = [
            int(mean(window(close, i, 5)) - mean(window(close, i, 20)) > 1e-9)
            for i in range(len(close))
        ]
        _, growth, drawdown = simulate(close, position)
        target = [int(y / x - 1 > 0.005) for x, y in zip(close, close[1:])] + [0]
        assert close_to(row["total_return"], growth[-1] - 1)
        assert close_to(row["max_drawdown"], min(drawdown[1:]))
        hit = mean([float(p == t) for p, t in zip(position, target)])
        assert close_to(row["accuracy"], hit)


def test_short_windows_are_reported_not_evaluated(spark):
    bars = bars_frame(spark, walk("A", 200))
    status = wf.walk_forward_status(bars, train=60, test=20, step=20)
    assert status.count() == len(loop_windows(200, 60, 20, 20))
    assert status.filter("evaluated").count() == 0
    assert wf.walk_forward_rule(bars, train=60, test=20, step=20).count() == 0
