"""Fixtures and slow, obvious reference computations for the tests."""

import datetime as dt
import math
import random

BARS = "ticker string, date date, Open double, High double, Low double, Close double, Volume double"
DAY0 = dt.date(2001, 1, 1)


def walk(ticker, n, seed=1, start=100.0, gap_days=1):
    """A random series of bars as tuples."""
    rng = random.Random(seed)
    rows, price = [], start
    for i in range(n):
        opened = price * (1 + rng.uniform(-0.01, 0.01))
        price = max(1.0, price * (1 + rng.uniform(-0.03, 0.03)))
        high = max(opened, price) * (1 + rng.uniform(0, 0.01))
        low = min(opened, price) * (1 - rng.uniform(0, 0.01))
        day = DAY0 + dt.timedelta(days=i * gap_days)
        rows.append((ticker, day, opened, high, low, price, float(rng.randint(0, 5000))))
    return rows


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def deviation(xs):
    xs = [x for x in xs if x is not None]
    if len(xs) < 2:
        return None
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))


def window(xs, i, n):
    return xs[max(0, i - n + 1) : i + 1]


def ema(xs, span):
    a = 2 / (span + 1)
    out = [xs[0]]
    for x in xs[1:]:
        out.append(a * x + (1 - a) * out[-1])
    return out


def over(a, b):
    return None if a is None or b is None or b == 0 else a / b


def minus(a, b):
    return None if a is None or b is None else a - b


def feature_rows(rows):
    """Every feature of every bar of one series, computed bar by bar."""
    o, h, l, c, v = ([r[k] for r in rows] for k in range(2, 7))
    n = len(rows)
    before = lambda xs, i, k: xs[i - k] if i >= k else None
    move = lambda i, k: minus(over(c[i], before(c, i, k)), 1.0)
    r1 = [move(i, 1) for i in range(n)]
    step = [0.0 if i == 0 else c[i] - c[i - 1] for i in range(n)]
    e = {s: ema(c, s) for s in (5, 10, 12, 20, 26)}
    macd = [a - b for a, b in zip(e[12], e[26])]
    signal = ema(macd, 9)
    spread = [over(minus(h[i], l[i]), c[i]) for i in range(n)]
    true_range, plus, minus_move = [], [], []
    for i in range(n):
        prior = before(c, i, 1)
        options = [minus(h[i], l[i])]
        if prior is not None:
            options += [abs(x - prior) for x in (h[i], l[i]) if x is not None]
        options = [x for x in options if x is not None]
        true_range.append(max(options) if options else None)
        up, down = minus(h[i], before(h, i, 1)), minus(before(l, i, 1), l[i])
        known = up is not None and down is not None
        plus.append(up if known and up > down and up > 0 else 0.0)
        minus_move.append(down if known and down > up and down > 0 else 0.0)
    atr = [mean(window(true_range, i, 14)) for i in range(n)]
    dx = []
    for i in range(n):
        p, m = (over(mean(window(x, i, 14)), atr[i]) for x in (plus, minus_move))
        ok = p is not None and m is not None
        dx.append(100 * abs(100 * p - 100 * m) / (100 * p + 100 * m + 1e-10) if ok else None)
    out = []
    for i in range(n):
        f = {f"pct_change_{k}": move(i, k) for k in (1, 2, 3)}
        for k in (5, 10, 20):
            f[f"sma_{k}"] = mean(window(c, i, k))
            f[f"close_to_sma{k}"] = over(c[i] - f[f"sma_{k}"], f[f"sma_{k}"])
            f[f"close_to_ema{k}"] = over(c[i] - e[k][i], e[k][i])
            f[f"volatility_{k}"] = deviation(window(r1, i, k))
        gain = mean([max(s, 0.0) for s in window(step, i, 14)])
        loss = mean([max(-s, 0.0) for s in window(step, i, 14)])
        f["rsi"] = 100 - 100 / (1 + gain / (loss + 1e-10))
        f["rolling_std_10"] = deviation(window(c, i, 10))
        volume = mean(window(v, i, 10))
        f["volume_zscore"] = over(v[i] - volume, volume)
        f["hl_range"] = spread[i]
        f["hl_range_5"] = mean(window(spread, i, 5))
        f["price_position"] = over(minus(c[i], l[i]), None if h[i] is None else h[i] - l[i] + 1e-10)
        f["macd"], f["macd_signal"] = macd[i], signal[i]
        f["macd_histogram"] = macd[i] - signal[i]
        sd, mid = deviation(window(c, i, 20)), f["sma_20"]
        f["bb_width"] = None if sd is None else over(4 * sd, mid)
        f["bb_position"] = None if sd is None else (c[i] - (mid - 2 * sd)) / (4 * sd + 1e-10)
        f["momentum_5"], f["momentum_10"] = move(i, 5), move(i, 10)
        for k in (5, 10):
            m = move(i, k)
            f[f"roc_{k}"] = None if m is None else 100 * m
        f["volume_ratio"] = over(v[i], mean(window(v, i, 20)))
        flow = [None if r is None else r * w for r, w in zip(window(r1, i, 5), window(v, i, 5))]
        f["volume_price_trend"] = None if mean(flow) is None else sum(x for x in flow if x is not None)
        f["atr_14"] = atr[i]
        more = lambda a, b: float(a is not None and b is not None and a > b)
        f["higher_high"] = more(h[i], before(h, i, 1))
        f["lower_low"] = more(before(l, i, 1), l[i])
        f["gap_up"] = more(o[i], before(c, i, 1))
        f["gap_down"] = more(before(c, i, 1), o[i])
        f["adx"] = mean(window(dx, i, 14))
        first = window(c, i, 10)[0]
        f["trend_strength"] = float((c[i] > first) - (c[i] < first))
        out.append({k: 0.0 if x is None else x for k, x in f.items()})
    return out


def close_to(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
