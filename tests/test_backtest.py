import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.backtest import backtest_signals, perf_metrics, signal_panel, strategy_returns, equity_curve
from barloom.operators.metrics import returns_histogram
from barloom.operators.signals import rule_curve

from helpers import DAY0, bars_frame, close_to, deviation, mean, walk, window

SIGNALS = "ticker string, date date, position int, price double"


def signals(spark, prices, positions, ticker="A"):
    days = [DAY0 + dt.timedelta(days=i) for i in range(len(prices))]
    rows = [(ticker, d, p, float(x)) for d, p, x in zip(days, positions, prices)]
    return spark.createDataFrame(rows, SIGNALS)


def simulate(prices, positions, cost=0.001):
    """Day by day: returns, growth, drawdown."""
    r, growth, peak = [None], [None], None
    drawdown, total = [None], 1.0
    for i in range(1, len(prices)):
        move = prices[i] / prices[i - 1] - 1 if prices[i - 1] else 0.0
        r.append(positions[i - 1] * move - abs(positions[i] - positions[i - 1]) * cost)
        total *= 1 + r[-1]
        growth.append(total)
        peak = total if peak is None else max(peak, total)
        drawdown.append((total - peak) / peak if peak else None)
    return r, growth, drawdown


def random_case(n, seed, crash=False):
    rng = random.Random(seed)
    prices = [100.0]
    for _ in range(n - 1):
        prices.append(max(0.5, prices[-1] * (1 + rng.uniform(-0.04, 0.04))))
    if crash:
        prices[n // 2] = 0.01  # loses more than everything once costs are paid
    return prices, [rng.randint(0, 1) for _ in range(n)]


@pytest.mark.parametrize("crash", [False, True])
def test_curve_across_chunks(spark, crash):
    prices, positions = random_case(1400, 11, crash)
    if crash:
        positions[1400 // 2 - 1], positions[1400 // 2] = 1, 0
    r, growth, drawdown = simulate(prices, positions)
    df = backtest_signals(signals(spark, prices, positions), chunk_rows=512)
    got = df.orderBy("date").collect()
    for i, row in enumerate(got):
        assert close_to(row["returns"], r[i], 1e-12)
        assert close_to(row["cumulative_returns"], growth[i], 1e-10)
        assert close_to(row["drawdown"], drawdown[i], 1e-9)
        assert close_to(row["buy_and_hold"], prices[i] / prices[0] * 10000, 1e-12)
        want = None if growth[i] is None else growth[i] * 10000
        assert close_to(row["capital"], want, 1e-10)


def test_growth_that_turns_negative(spark):
    """A loss of more than the capital flips the sign of all that follows."""
    prices = [100.0, 50.0, 0.01, 0.02, 0.03, 0.025, 0.05]
    positions = [1, 1, 0, 1, 1, 1, 0]
    n = 600
    prices = prices + [0.05 + 0.01 * (i % 7) for i in range(n)]
    positions = positions + [(i // 3) % 2 for i in range(n)]
    r, growth, drawdown = simulate(prices, positions, cost=0.5)
    assert min(g for g in growth[1:]) < 0
    got = backtest_signals(signals(spark, prices, positions), cost=0.5, chunk_rows=512)
    for i, row in enumerate(got.orderBy("date").collect()):
        assert close_to(row["cumulative_returns"], growth[i], 1e-9)
        assert close_to(row["drawdown"], drawdown[i], 1e-9)


def test_metrics(spark):
    prices, positions = random_case(900, 5)
    r, growth, drawdown = simulate(prices, positions)
    m = perf_metrics(backtest_signals(signals(spark, prices, positions), chunk_rows=512)).first()
    known = r[1:]
    total = growth[-1] - 1
    vol = deviation(known) * math.sqrt(252)
    annual = (1 + total) ** (252 / len(known)) - 1
    wins = [x for x in known if x > 0]
    losses = [x for x in known if x < 0]
    assert close_to(m["total_return"], total)
    assert close_to(m["annualized_return"], annual)
    assert close_to(m["volatility"], vol)
    assert close_to(m["sharpe_ratio"], annual / vol)
    assert close_to(m["max_drawdown"], min(drawdown[1:]))
    assert m["max_drawdown"] <= 0
    assert m["total_trades"] == len(wins) + len(losses)
    assert m["winning_trades"] == len(wins)
    assert close_to(m["win_rate"], len(wins) / (len(wins) + len(losses)))
    assert close_to(m["profit_factor"], sum(wins) / abs(sum(losses)))


def test_never_invested(spark):
    m = perf_metrics(backtest_signals(signals(spark, [1, 2, 3, 4], [0, 0, 0, 0]))).first()
    for name in ("total_return", "volatility", "sharpe_ratio", "win_rate", "profit_factor"):
        assert m[name] == 0.0
    assert m["total_trades"] == 0


def test_always_winning_has_no_profit_factor(spark):
    m = perf_metrics(backtest_signals(signals(spark, [1, 2, 3, 5], [1, 1, 1, 1]))).first()
    assert m["win_rate"] == 1.0 and m["profit_factor"] == 0.0
    assert close_to(m["total_return"], 4.0)


def test_single_bar_gives_zeros(spark):
    m = perf_metrics(backtest_signals(signals(spark, [7], [1]))).first()
    assert all(m[c] == 0 for c in m.asDict() if c != "ticker")


def test_zero_price_earns_nothing_next_day(spark):
    rows = backtest_signals(signals(spark, [5, 0, 5], [1, 1, 1])).orderBy("date").collect()
    assert [r["price_return"] for r in rows] == [0.0, -1.0, 0.0]


def test_rule_backtest_equals_its_parts(spark):
    bars = walk("A", 700, seed=12)
    close = [b[5] for b in bars]
    position = [
        int(mean(window(close, i, 5)) - mean(window(close, i, 20)) > 1e-9) for i in range(700)
    ]
    r, growth, _ = simulate(close, position)
    got = rule_curve(bars_frame(spark, bars), chunk_rows=512).orderBy("date").collect()
    assert [g["position"] for g in got] == position
    assert all(close_to(g["cumulative_returns"], w, 1e-10) for g, w in zip(got, growth))


def test_rules_side_by_side_equal_single_runs(spark):
    bars = bars_frame(spark, walk("A", 1200, seed=13) + walk("B", 60, seed=14))
    both = rule_curve(bars, ("sma_cross", "macd_trend"), chunk_rows=512)
    for rule in ("sma_cross", "macd_trend"):
        one = rule_curve(bars, (rule,), chunk_rows=512)
        keys = ["ticker", "date", "cumulative_returns", "drawdown"]
        a = one.select(*keys).orderBy("ticker", "date").collect()
        b = both.filter(F.col("model") == rule).select(*keys).orderBy("ticker", "date").collect()
        assert len(a) == len(b) == 1260
        for x, y in zip(a, b):
            assert close_to(x[2], y[2], 1e-12) and close_to(x[3], y[3], 1e-12)


@pytest.mark.parametrize("chunk_rows", [512, 32768])
def test_extremes_come_with_the_totals_of_chunks(spark, chunk_rows):
    """Series of several chunks, of one bar and without a move."""
    prices, positions = random_case(1400, 8)
    both = signals(spark, prices, positions).unionByName(signals(spark, [5.0], [1], "B"))
    both = both.unionByName(signals(spark, [7.0] * 600, [1] * 600, "C"))
    panel = strategy_returns(signal_panel(both, chunk_rows=chunk_rows))
    carried = equity_curve(panel, extremes=True)
    plain = equity_curve(panel)
    assert set(carried.columns) - set(plain.columns) == {"least_return", "largest_return"}
    known = {r["ticker"]: r for r in plain.groupBy("ticker").agg(F.min("returns").alias("lo"), F.max("returns").alias("hi")).collect()}
    for r in carried.select("ticker", "least_return", "largest_return").distinct().collect():
        assert (r["least_return"], r["largest_return"]) == (known[r["ticker"]]["lo"], known[r["ticker"]]["hi"])
    found = [sorted(returns_histogram(c, bins=9).collect()) for c in (carried, plain)]
    assert found[0] == found[1] and {r["ticker"] for r in found[0]} == {"A", "C"}
    assert sum(r["n"] for r in found[0] if r["ticker"] == "A") == 1399


def test_totals_and_rows_share_an_exchange(spark):
    """The date is in no total of a chunk; it must not make a second exchange, and signals with positions are not numbered again."""
    prices, positions = random_case(900, 4)
    placed = signals(spark, prices, positions).withColumns({"idx": F.datediff("date", F.lit(DAY0)).cast("long"), "n_bars": F.lit(900).cast("long")})
    curve = backtest_signals(placed, chunk_rows=512).select("ticker", "date", "position", "price", "returns", "capital")
    assert curve.count() == 900
    rows = curve.collect()
    plan = curve._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(exchanges) == 2 and "ReusedExchange" in exchanges[1] and "row_number" not in plan
    numbered = backtest_signals(signals(spark, prices, positions), chunk_rows=512).select(*curve.columns).collect()
    assert sorted(rows) == sorted(numbered)
