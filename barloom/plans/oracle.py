"""ANSI-style SQL that recomputes the registered queries from the raw tables.

Written independently of the DataFrame code: plain windows over the whole
series, a recursive query for the exponential averages, pairwise counting for
the ROC area.  It is meant for small data, as a check.
"""

from __future__ import annotations

from barloom.functions.indicators import FEATURE_COLS
from barloom.functions.maths import NUDGE
from barloom.plans.queries import FEATURE_GROUPS, PRICE_SCALE, SCALED

# ------------------------------------------------------------------ bars

LINE_KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
DAILY = f"""bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice / l_quantity, {LINE_KEY}) AS "Open",
    max(l_extendedprice / l_quantity) AS "High",
    min(l_extendedprice / l_quantity) AS "Low",
    arg_max(l_extendedprice / l_quantity, {LINE_KEY}) AS "Close",
    sum(l_quantity) AS "Volume"
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _event_bars(price: str, unit: str = "hour", ticker: str = "event_type") -> str:
    date = f"date_trunc('{unit}', ts)"
    if unit == "day":
        date = "CAST(ts AS DATE)"
    return f"""bars AS (
  SELECT {ticker} AS ticker, {date} AS date,
    arg_min({price}, row(ts, event_id)) AS "Open", max({price}) AS "High",
    min({price}) AS "Low", arg_max({price}, row(ts, event_id)) AS "Close",
    count(*)::DOUBLE AS "Volume"
  FROM events GROUP BY 1, 2)"""


HOURLY = _event_bars("value")
INDEX = _event_bars("(100.0::DOUBLE + value / 50.0::DOUBLE)")
USERS = _event_bars("value", "day", "CAST(user_id AS VARCHAR)")

BAR_COLS = ["Open", "High", "Low", "Close", "Volume"]


def r(column: str, digits: int = 6, expr: str | None = None) -> str:
    return f'round({expr or chr(34) + column + chr(34)}, {digits}) + 0.0::DOUBLE AS "{column}"'


def rs(columns, digits: int = 6, special: dict | None = None) -> str:
    special = special or {}
    return ", ".join(r(c, special.get(c, digits)) for c in columns)


EXACT = 9
BARS_OUT = "ticker, date, " + rs(BAR_COLS, EXACT)


def sql(ctes: list[str], final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


# -------------------------------------------------------------- features


def roll(fn: str, expr: str, n: int, key: str = "ticker") -> str:
    return (
        f"{fn}({expr}) OVER (PARTITION BY {key} ORDER BY idx "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


def lag(column: str, n: int = 1, key: str = "ticker") -> str:
    return f'lag("{column}", {n}) OVER (PARTITION BY {key} ORDER BY idx)'


def indexed(source: str = "bars", min_rows: int = 26, where: str = "TRUE") -> str:
    return f"""ib AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx,
    count(*) OVER (PARTITION BY ticker) AS n_bars FROM {source} WHERE {where})
  WHERE n_bars >= {min_rows})"""


def average_step(name: str, span: int, x: str, prior: str) -> str:
    a = 2.0 / (span + 1)
    return f"{a!r}::DOUBLE * {x} + {1 - a!r}::DOUBLE * {prior} AS {name}"


AVERAGES = (
    """ema AS (
  SELECT ticker, idx, "Close" AS e5, "Close" AS e10, "Close" AS e12, "Close" AS e20,
    "Close" AS e26, 0.0::DOUBLE AS sig FROM ib WHERE idx = 0
  UNION ALL
  SELECT ticker, idx, e5, e10, e12, e20, e26,
    """
    + average_step("sig", 9, "(e12 - e26)", "sig")
    + """ FROM (SELECT b.ticker, b.idx, """
    + ", ".join(
        average_step(f"e{n}", n, 'b."Close"', f"p.e{n}") for n in (5, 10, 12, 20, 26)
    )
    + """, p.sig AS sig FROM ema p JOIN ib b ON b.ticker = p.ticker AND b.idx = p.idx + 1))"""
)
NO_AVERAGES = (
    "ema AS (SELECT ticker, idx, 1.0::DOUBLE AS e5, 1.0::DOUBLE AS e10, 1.0::DOUBLE AS e12, "
    "1.0::DOUBLE AS e20, 1.0::DOUBLE AS e26, 0.0::DOUBLE AS sig FROM ib)"
)


def features(averages: bool, key: str = "ticker") -> list[str]:
    """CTEs ending in ``f``: every indicator, missing values as NULL."""
    join_on = " AND ".join(f"ema.{k.strip()} = ib.{k.strip()}" for k in key.split(","))
    c, h, l, o, v = ('"Close"', '"High"', '"Low"', '"Open"', '"Volume"')
    f1 = f"""f1 AS (SELECT ib.*, e5, e10, e12, e20, e26, sig,
    {", ".join(f"{lag('Close', k, key)} AS c{k}" for k in (1, 2, 3, 5, 10))},
    {lag("High", 1, key)} AS h1, {lag("Low", 1, key)} AS l1,
    {", ".join(f"{roll('avg', c, n, key)} AS sma_{n}" for n in (5, 10, 20))},
    {roll("stddev_samp", c, 10, key)} AS rolling_std_10,
    {roll("stddev_samp", c, 20, key)} AS std20,
    {roll("avg", v, 10, key)} AS volume_sma_10, {roll("avg", v, 20, key)} AS v20,
    {roll("first_value", c, 10, key)} AS oldest,
    lead({c}) OVER (PARTITION BY {key} ORDER BY idx) AS next_close
    FROM ib JOIN ema ON {join_on} AND ema.idx = ib.idx)"""
    f1 = f1.replace(f"PARTITION BY {key}", "PARTITION BY " + ", ".join(
        f"ib.{k.strip()}" for k in key.split(",")
    )).replace("ORDER BY idx", "ORDER BY ib.idx")
    f2 = f"""f2 AS (SELECT *,
    {c} / nullif(c1, 0) - 1 AS pct_change_1, {c} / nullif(c2, 0) - 1 AS pct_change_2,
    {c} / nullif(c3, 0) - 1 AS pct_change_3, {c} / nullif(c5, 0) - 1 AS momentum_5,
    {c} / nullif(c10, 0) - 1 AS momentum_10,
    ({c} - c5) / nullif(c5, 0) * 100 AS roc_5, ({c} - c10) / nullif(c10, 0) * 100 AS roc_10,
    coalesce(greatest({c} - c1, 0), 0) AS gain, coalesce(greatest(c1 - {c}, 0), 0) AS loss,
    ({h} - {l}) / nullif({c}, 0) AS hl_range,
    ({c} - {l}) / nullif({h} - {l} + 1e-10, 0) AS price_position,
    greatest({h} - {l}, abs({h} - c1), abs({l} - c1)) AS tr,
    CASE WHEN {h} - h1 > l1 - {l} AND {h} - h1 > 0 THEN {h} - h1 ELSE 0 END AS pm,
    CASE WHEN l1 - {l} > {h} - h1 AND l1 - {l} > 0 THEN l1 - {l} ELSE 0 END AS mm,
    e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_histogram,
    sma_20 AS bb_middle, sma_20 + 2 * std20 AS bb_upper, sma_20 - 2 * std20 AS bb_lower,
    4 * std20 / nullif(sma_20, 0) AS bb_width,
    ({c} - (sma_20 - 2 * std20)) / (4 * std20 + 1e-10) AS bb_position,
    coalesce(CAST({h} > h1 AS INT), 0) AS higher_high,
    coalesce(CAST({l} < l1 AS INT), 0) AS lower_low,
    coalesce(CAST({o} > c1 AS INT), 0) AS gap_up,
    coalesce(CAST({o} < c1 AS INT), 0) AS gap_down,
    CASE WHEN {c} > oldest THEN 1 WHEN {c} < oldest THEN -1 ELSE 0 END AS trend_strength,
    ({v} - volume_sma_10) / nullif(volume_sma_10, 0) AS volume_zscore,
    {v} / nullif(v20, 0) AS volume_ratio,
    e5 AS ema_5, e10 AS ema_10, e20 AS ema_20,
    {", ".join(f"({c} - sma_{n}) / nullif(sma_{n}, 0) AS close_to_sma{n}" for n in (5, 10, 20))},
    {", ".join(f"({c} - e{n}) / nullif(e{n}, 0) AS close_to_ema{n}" for n in (5, 10, 20))},
    (next_close - {c}) / nullif({c}, 0) AS next_pct_change
    FROM f1)"""
    f3 = f"""f3 AS (SELECT *,
    100 - 100 / (1 + {roll("avg", "gain", 14, key)}
      / ({roll("avg", "loss", 14, key)} + 1e-10)) AS rsi,
    {roll("avg", "hl_range", 5, key)} AS hl_range_5,
    {roll("sum", v + " * pct_change_1", 5, key)} AS volume_price_trend,
    {roll("avg", "tr", 14, key)} AS atr_14,
    {roll("avg", "pm", 14, key)} AS pma, {roll("avg", "mm", 14, key)} AS mma,
    {", ".join(f"{roll('stddev_samp', 'pct_change_1', n, key)} AS volatility_{n}" for n in (5, 10, 20))},
    coalesce(CAST(next_pct_change > 0.005::DOUBLE AS INT), 0) AS target
    FROM f2)"""
    f4 = """f4 AS (SELECT *, 100 * abs(100 * pma / nullif(atr_14, 0) - 100 * mma / nullif(atr_14, 0))
    / (100 * pma / nullif(atr_14, 0) + 100 * mma / nullif(atr_14, 0) + 1e-10) AS dx FROM f3)"""
    f = f"f AS (SELECT *, {roll('avg', 'dx', 14, key)} AS adx FROM f4)"
    return [AVERAGES if averages else NO_AVERAGES, f1, f2, f3, f4, f]


PLAIN = features(False)
FULL = features(True)


def filled(columns) -> str:
    parts = []
    for c in columns:
        value = f'coalesce(CAST("{c}" AS DOUBLE), 0)'
        if c in PRICE_SCALE:
            value += f" + {NUDGE!r}::DOUBLE"
        parts.append(r(c, PRICE_SCALE.get(c, 6), value))
    return ", ".join(parts)


SQL: dict[str, str] = {
    "bars_daily": sql([DAILY], f"SELECT {BARS_OUT} FROM bars"),
    "bars_hourly": sql([HOURLY], f"SELECT {BARS_OUT} FROM bars"),
    "bars_index": sql([INDEX], f"SELECT {BARS_OUT} FROM bars"),
    "bars_lookback": sql(
        [DAILY],
        f"SELECT {BARS_OUT} FROM bars "
        "WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 24 MONTH",
    ),
}

# New York is four hours behind UTC from the second Sunday in March to the
# first in November (from 2007), or from the first Sunday in April to the last
# in October (before); five hours otherwise.  The order dates end in 2001.
SUMMER = """utc >= april + CAST((7 - dayofweek(april)) % 7 AS INT) * INTERVAL 1 DAY + INTERVAL 7 HOUR
  AND utc < october - CAST(dayofweek(october) AS INT) * INTERVAL 1 DAY + INTERVAL 6 HOUR"""
SQL["normalize_bars"] = sql(
    [
        """t AS (SELECT *, o_orderdate
    + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 4 HOUR END AS utc,
    make_timestamp(year(o_orderdate), 4, 1, 0, 0, 0) AS april,
    make_timestamp(year(o_orderdate), 10, 31, 0, 0, 0) AS october FROM orders)"""
    ],
    f"""SELECT o_orderpriority AS ticker,
    CAST(utc - CASE WHEN {SUMMER} THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS DATE) AS date,
    {", ".join(r(c, 9, "o_totalprice") for c in BAR_COLS[:4])},
    {r("Volume", 6, "CAST(o_orderkey AS DOUBLE)")} FROM t""",
)

DIRTY = """dirty AS (SELECT ticker, date, "Open",
    CASE WHEN day(date) = 10 THEN NULL ELSE "High" END AS "High", "Low",
    CASE WHEN day(date) IN (7, 8) THEN NULL ELSE "Close" END AS "Close",
    CASE WHEN day(date) = 9 THEN NULL ELSE "Volume" END AS "Volume" FROM bars)"""
SQL["coerce_bars"] = sql([DAILY, DIRTY], f"SELECT {BARS_OUT} FROM dirty")
SQL["clean_bars"] = sql(
    [DAILY, DIRTY],
    f'SELECT {BARS_OUT} FROM dirty WHERE "Close" IS NOT NULL AND "Volume" IS NOT NULL',
)
SQL["dedupe_bars"] = f"""SELECT ticker, date, {rs(["Close", "Volume"], 9)} FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
    l_extendedprice AS "Close", l_quantity AS "Volume",
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
        l_extendedprice DESC, l_quantity DESC) AS k
  FROM lineitem) WHERE k = 1"""
SQL["min_history"] = sql(
    [USERS],
    f"""SELECT {BARS_OUT}, n_bars FROM (
    SELECT *, count(*) OVER (PARTITION BY ticker) AS n_bars FROM bars) WHERE n_bars >= 5""",
)
SQL["date_range"] = sql(
    [HOURLY],
    f"SELECT {BARS_OUT} FROM bars WHERE CAST(date AS DATE) "
    "BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
)
SQL["validate_bars"] = sql(
    [
        DAILY,
        DIRTY,
        USERS.replace("bars AS", "users AS"),
        """every AS (SELECT ticker, CASE WHEN day(date) <> 11 THEN date END AS date, "Close", "Volume" FROM dirty
    UNION ALL SELECT ticker, date, "Close", "Volume" FROM users)""",
        """counts AS (SELECT ticker, count(*) AS n_rows,
    count(*) FILTER (WHERE "Close" IS NULL OR "Volume" IS NULL) AS n_missing,
    count(*) FILTER (WHERE date IS NULL) AS n_bad_dates
    FROM every GROUP BY ticker)""",
    ],
    """SELECT *, error_message = '' AS is_valid FROM (SELECT *, CASE
    WHEN n_rows < 5 THEN n_rows || ' bars, 5 are needed'
    WHEN n_bad_dates > 0 THEN n_bad_dates || ' bars have no valid date'
    WHEN n_missing > 0 THEN n_missing || ' bars lack a close or a volume'
    ELSE '' END AS error_message FROM counts)""",
)
LISTED = "('BRAND#11'), ('BRAND#23'), ('BRAND#4'), ('BRAND#99')"
SQL["watchlist_bars"] = sql(
    [DAILY],
    f"SELECT upper(ticker) AS ticker, date, {rs(BAR_COLS, EXACT)} FROM bars "
    f"WHERE upper(ticker) IN (SELECT * FROM (VALUES {LISTED}))",
)
SQL["ingest_status"] = sql(
    [DAILY],
    f"""SELECT w.ticker, count(b.date) AS n_rows, min(b.date) FILTER (WHERE day(b.date) <> 11) AS first_date,
    max(b.date) FILTER (WHERE day(b.date) <> 11) AS last_date,
    count(b.date) FILTER (WHERE day(b.date) = 11) AS n_bad_dates,
    CASE WHEN count(b.date) > 0 THEN 'loaded' ELSE 'no data' END AS status
    FROM (VALUES {LISTED}) AS w(ticker) LEFT JOIN bars b ON upper(b.ticker) = w.ticker
    GROUP BY w.ticker""",
)
SQL["ticker_overview"] = sql(
    [DAILY],
    f"""SELECT ticker, n_rows, {r("latest_close", EXACT)}, {r("change", EXACT, "latest_close - previous")},
    {r("change_pct", EXACT, "CASE WHEN previous > 0 THEN (latest_close - previous) / previous * 100 ELSE 0 END")},
    first_date, last_date, {r("avg_volume", EXACT)} FROM (
    SELECT ticker, count(*) AS n_rows, arg_max("Close", date) AS latest_close,
      coalesce(list("Close" ORDER BY date DESC)[2], arg_max("Close", date)) AS previous,
      min(date) AS first_date, max(date) AS last_date, avg("Volume") AS avg_volume
    FROM bars GROUP BY ticker)""",
)

for _name, _columns in FEATURE_GROUPS.items():
    _averages = any("ema" in c or "macd" in c for c in _columns)
    SQL[_name] = sql(
        [DAILY, indexed(), *(FULL if _averages else PLAIN)],
        f"SELECT ticker, date, {filled(_columns)} FROM f",
    )
SQL["label"] = sql(
    [DAILY, indexed(), *PLAIN],
    f'SELECT ticker, date, {rs(["next_close", "next_pct_change"], EXACT)}, target FROM f',
)
SQL["features_all"] = sql(
    [DAILY, indexed(), *FULL], f"SELECT ticker, date, {filled(FEATURE_COLS)}, target FROM f"
)
SQL["features_hourly"] = sql(
    [HOURLY, indexed(), *FULL], f"SELECT ticker, date, {filled(FEATURE_COLS)}, target FROM f"
)
SQL["features_from_ticks"] = sql(
    [HOURLY, indexed(), *FULL],
    f"SELECT ticker, date, idx, n_bars, {filled(FEATURE_COLS)}, target FROM f",
)
for _name, _rows in (("latest_features", 1), ("features_tail5", 5)):
    SQL[_name] = sql(
        [DAILY, indexed(), *FULL],
        f"SELECT ticker, date, {filled(FEATURE_COLS)} FROM f WHERE idx >= n_bars - {_rows}",
    )

# ---------------------------------------------------------- training data

SPLIT = "s AS (SELECT *, idx >= floor(n_bars * (1.0::DOUBLE - 0.2::DOUBLE)) AS is_test FROM f)"
SQL["label_distribution"] = sql(
    [DAILY, indexed(), *PLAIN], "SELECT ticker, target, count(*) AS n FROM f GROUP BY ALL"
)
SQL["time_split"] = sql(
    [DAILY, indexed(), *PLAIN, SPLIT], "SELECT ticker, date, idx, n_bars, is_test, target FROM s"
)
SQL["scale_features"] = sql(
    [
        DAILY,
        indexed(),
        *PLAIN,
        SPLIT,
        "z AS (SELECT ticker, date, is_test, "
        + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in SCALED)
        + " FROM s)",
        "m AS (SELECT ticker, "
        + ", ".join(
            f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS d_{c}"
            for c in SCALED
        )
        + " FROM z WHERE NOT is_test GROUP BY ticker)",
    ],
    "SELECT z.ticker, z.date, z.is_test, "
    + ", ".join(r(c, 6, f"(z.{c} - m_{c}) / d_{c}") for c in SCALED)
    + " FROM z JOIN m ON z.ticker = m.ticker",
)
SQL["class_weights"] = sql(
    [DAILY, indexed(), *PLAIN, SPLIT],
    f"""SELECT ticker, target, n_class, {r("weight", 6,
        "sum(n_class) OVER (PARTITION BY ticker) / (2.0::DOUBLE * n_class)")}
    FROM (SELECT ticker, target, count(*) AS n_class FROM s WHERE NOT is_test GROUP BY ALL)""",
)
SQL["cv_folds"] = sql(
    [DAILY, indexed(), *PLAIN],
    """SELECT ticker, date, target, CAST(least(3 * (row_number() OVER w - 1)
      // count(*) OVER (PARTITION BY ticker, target), 2) AS INT) AS fold
    FROM f WINDOW w AS (PARTITION BY ticker, target ORDER BY date)""",
)

# --------------------------------------------------------------- backtest

RULES = {
    "sma_cross": "sma_5 - sma_20 > 1e-9",
    "macd_trend": "macd_histogram > 1e-9",
    "rsi_high": "rsi - 50 > 1e-9",
}


def positions(rules: list[str]) -> str:
    return "p AS (" + " UNION ALL ".join(
        f"SELECT ticker, date, idx, n_bars, target, '{rule}' AS model, \"Close\" AS price, "
        f"coalesce(CAST({RULES[rule]} AS INT), 0) AS position FROM f"
        for rule in rules
    ) + ")"


def curve(key: str = "ticker") -> list[str]:
    w = f"(PARTITION BY {key} ORDER BY idx)"
    run = f"(PARTITION BY {key} ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    return [
        f"""r1 AS (SELECT *, coalesce(price / nullif(lag(price) OVER {w}, 0) - 1, 0) AS price_return,
    lag(position) OVER {w} AS held FROM p)""",
        """r2 AS (SELECT *, held * price_return - abs(position - held) * 0.001::DOUBLE AS returns
    FROM r1)""",
        f"""r3 AS (SELECT *, CASE WHEN returns IS NULL THEN NULL
      ELSE product(1 + returns) OVER {run} END AS cumulative_returns,
    price / nullif(first_value(price) OVER {run}, 0) * 10000 AS buy_and_hold FROM r2)""",
        f"r4 AS (SELECT *, max(cumulative_returns) OVER {run} AS running_max FROM r3)",
        """c AS (SELECT *, cumulative_returns * 10000 AS capital,
    (cumulative_returns - running_max) / nullif(running_max, 0) AS drawdown FROM r4)""",
    ]


PERF_COLS = [
    "total_return",
    "annualized_return",
    "volatility",
    "sharpe_ratio",
    "max_drawdown",
    "win_rate",
    "profit_factor",
]


def perf(key: str = "ticker") -> str:
    return f"""perf AS (SELECT *,
    CASE WHEN volatility > 0 THEN annualized_return / volatility ELSE 0 END AS sharpe_ratio
    FROM (SELECT *, (1 + total_return) ^ (252.0 / n) - 1 AS annualized_return FROM (
    SELECT {key}, count(returns) AS n, arg_max(cumulative_returns, idx) - 1 AS total_return,
      stddev_samp(returns) * sqrt(252) AS volatility, min(drawdown) AS max_drawdown,
      count(*) FILTER (WHERE returns <> 0) AS total_trades,
      count(*) FILTER (WHERE returns > 0) AS winning_trades,
      coalesce(count(*) FILTER (WHERE returns > 0)
        / nullif(count(*) FILTER (WHERE returns <> 0), 0), 0) AS win_rate,
      coalesce(sum(returns) FILTER (WHERE returns > 0)
        / nullif(abs(sum(returns) FILTER (WHERE returns < 0)), 0), 0) AS profit_factor
    FROM c GROUP BY {key})))"""


def hits(source: str, predicted: str, key: str = "ticker") -> str:
    return f"""hits AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
    coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score FROM (
    SELECT {key}, count(*) FILTER (WHERE target = 0 AND {predicted} = 0) AS tn,
      count(*) FILTER (WHERE target = 0 AND {predicted} = 1) AS fp,
      count(*) FILTER (WHERE target = 1 AND {predicted} = 0) AS fn,
      count(*) FILTER (WHERE target = 1 AND {predicted} = 1) AS tp FROM {source} GROUP BY {key}))"""


CROSS = [INDEX, indexed(), *PLAIN, positions(["sma_cross"]), *curve()]
SQL["strategy_returns"] = sql(
    CROSS,
    f'SELECT ticker, date, position, {rs(["price", "price_return", "returns"])} FROM c',
)
SQL["equity_curve"] = sql(
    CROSS, f'SELECT ticker, date, {rs(["returns", "cumulative_returns", "capital"])} FROM c'
)
SQL["perf_metrics"] = sql(
    [*CROSS, perf()], f"SELECT ticker, {rs(PERF_COLS)}, total_trades, winning_trades FROM perf"
)
SQL["buy_and_hold"] = sql(CROSS, f'SELECT ticker, date, {r("buy_and_hold")} FROM c')
SQL["drawdown_series"] = sql(
    CROSS,
    f'SELECT ticker, date, {r("running_max")}, {r("drawdown_pct", 6, "drawdown * 100")} FROM c',
)
SQL["returns_histogram"] = sql(
    [
        *CROSS,
        "b AS (SELECT ticker, min(returns) AS lo, max(returns) AS hi FROM c GROUP BY ticker)",
        """q AS (SELECT c.ticker, lo, hi, CAST(least(coalesce(floor((returns - lo)
      / nullif(hi - lo, 0) * 50), 0), 49) AS BIGINT) AS bin
    FROM c JOIN b ON c.ticker = b.ticker WHERE returns IS NOT NULL)""",
    ],
    f"""SELECT ticker, bin, {r("bin_start", 6, "lo + (hi - lo) * bin / 50")},
    {r("bin_end", 6, "lo + (hi - lo) * (bin + 1) / 50")}, count(*) AS n
    FROM q GROUP BY ticker, bin, lo, hi""",
)
SQL["signals_join"] = sql(
    [INDEX, indexed(), *PLAIN, positions(["rsi_high"]), *curve()],
    f'SELECT ticker, date, position, {rs(["price", "returns", "capital"])} FROM c',
)
HIT_COLS = ["accuracy", "precision", "recall", "f1_score"]
SQL["backtest_rule"] = sql(
    [
        INDEX,
        indexed(where="CAST(date AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"),
        *FULL,
        positions(["macd_trend"]),
        *curve(),
        perf(),
        hits("c", "position"),
    ],
    f"""SELECT perf.ticker, {rs(PERF_COLS)}, total_trades, winning_trades, {rs(HIT_COLS)},
    tn, fp, fn, tp FROM perf JOIN hits ON perf.ticker = hits.ticker""",
)
ALL_RULES = [INDEX, indexed(), *FULL, positions(list(RULES)), *curve("ticker, model")]
SQL["compare_signals"] = sql(
    [*ALL_RULES, perf("ticker, model"), hits("c", "position", "ticker, model")],
    f"""SELECT perf.ticker, perf.model, {rs(["accuracy", "sharpe_ratio", "total_return",
    "max_drawdown", "win_rate", "f1_score"])}
    FROM perf JOIN hits ON perf.ticker = hits.ticker AND perf.model = hits.model""",
)

def _shown(column: str) -> str:
    text = "printf('%.2f%%', {0} * 100)" if column not in ("sharpe_ratio", "f1_score") else "printf('%.2f', {0})"
    return text.format(f"coalesce({column}, 0)") + f" AS {column}"


SQL["comparison_display"] = sql(
    [*ALL_RULES, perf("ticker, model"), hits("c", "position", "ticker, model")],
    f"""SELECT perf.ticker, perf.model, {", ".join(map(_shown, ["accuracy", "sharpe_ratio", "total_return",
    "max_drawdown", "win_rate", "f1_score"]))}
    FROM perf JOIN hits ON perf.ticker = hits.ticker AND perf.model = hits.model""",
)

# ------------------------------------------------------------ walk forward


def windows(train: int = 252, test: int = 63, step: int = 21) -> str:
    return f"""win AS (SELECT i.*, k AS window_id FROM ib i,
    (SELECT ticker AS t, unnest(generate_series(0, (n_bars - {train + test}) // {step})) AS k
      FROM ib WHERE idx = 0 AND n_bars >= {train + test}) g
    WHERE g.t = i.ticker AND idx >= k * {step} + {train}
      AND idx < k * {step} + {train + test})"""


SQL["walk_forward_windows"] = sql(
    [INDEX, indexed(min_rows=1), windows()], "SELECT ticker, date, idx, window_id FROM win"
)
SQL["walk_forward_bounds"] = sql(
    [
        INDEX,
        indexed(min_rows=1),
        """g AS (SELECT ticker, unnest(generate_series(0, (n_bars - 315) // 21)) AS window_id
    FROM ib WHERE idx = 0 AND n_bars >= 315)""",
    ],
    """SELECT g.ticker, window_id,
    min(date) FILTER (WHERE idx < window_id * 21 + 252) AS train_start,
    max(date) FILTER (WHERE idx < window_id * 21 + 252) AS train_end,
    min(date) FILTER (WHERE idx >= window_id * 21 + 252) AS test_start,
    max(date) FILTER (WHERE idx >= window_id * 21 + 252) AS test_end
    FROM g JOIN ib ON g.ticker = ib.ticker AND idx >= window_id * 21 AND idx < window_id * 21 + 315
    GROUP BY ALL""",
)
SQL["walk_forward_rule"] = sql(
    [
        INDEX,
        indexed(min_rows=1).replace("ib AS", "whole AS"),
        windows().replace("FROM ib", "FROM whole"),
        """ib AS (SELECT ticker, window_id, date, "Open", "High", "Low", "Close", "Volume",
    row_number() OVER (PARTITION BY ticker, window_id ORDER BY idx) - 1 AS idx,
    count(*) OVER (PARTITION BY ticker, window_id) AS n_bars FROM win)""",
        NO_AVERAGES.replace("SELECT ticker,", "SELECT ticker, window_id,"),
        *features(False, "ticker, window_id")[1:],
        positions(["sma_cross"]).replace("SELECT ticker,", "SELECT ticker, window_id,"),
        *curve("ticker, window_id"),
        perf("ticker, window_id"),
        hits("c", "position", "ticker, window_id"),
    ],
    f"""SELECT perf.ticker, perf.window_id, {rs(PERF_COLS)}, total_trades, winning_trades,
    {rs(HIT_COLS)}, tn, fp, fn, tp FROM perf
    JOIN hits ON perf.ticker = hits.ticker AND perf.window_id = hits.window_id""",
)
SQL["walk_forward_status"] = sql(
    [DAILY, DIRTY, indexed("dirty", 1), windows(120, 40, 20)],
    """SELECT ticker, window_id, n_rows, n_rows >= 26 AS evaluated FROM (
    SELECT ticker, window_id,
      count(*) FILTER (WHERE "Close" IS NOT NULL AND "Volume" IS NOT NULL) AS n_rows
    FROM win GROUP BY ALL)""",
)

# ---------------------------------------------------------- classification

SCORED = [
    INDEX,
    indexed(),
    *PLAIN,
    """p AS (SELECT *, round(rsi / 100, 4) AS prob_up,
    coalesce(CAST(rsi - 50 > 1e-9 AS INT), 0) AS prediction FROM f)""",
]
AREA = """area AS (SELECT ticker, coalesce(sum(won) / nullif(
      sum(pos) * sum(neg), 0), 0) AS roc_auc FROM (
    SELECT a.ticker, a.pos, a.neg, a.pos * (a.neg / 2.0 + coalesce((
      SELECT sum(b.neg) FROM tally b WHERE b.ticker = a.ticker AND b.prob_up < a.prob_up), 0)) AS won
    FROM tally a) GROUP BY ticker)"""
TALLY = """tally AS (SELECT ticker, prob_up, sum(target)::DOUBLE AS pos,
    sum(1 - target)::DOUBLE AS neg FROM p GROUP BY ALL)"""
SQL["class_metrics"] = sql(
    [*SCORED, hits("p", "prediction"), TALLY, AREA],
    f"""SELECT hits.ticker, {rs(HIT_COLS)}, tn, fp, fn, tp, {r("roc_auc")}
    FROM hits JOIN area ON hits.ticker = area.ticker""",
)
SQL["roc_auc"] = sql([*SCORED, TALLY, AREA], f'SELECT ticker, {r("roc_auc")} FROM area')
SQL["confusion_matrix"] = sql(
    [*SCORED, hits("p", "prediction")], "SELECT ticker, tn, fp, fn, tp FROM hits"
)
SQL["confusion_rows"] = sql(
    SCORED,
    """SELECT t.ticker, a AS actual, b AS predicted, count(p.ticker) AS n
    FROM (SELECT DISTINCT ticker FROM p) t CROSS JOIN (VALUES (0), (1)) x(a)
    CROSS JOIN (VALUES (0), (1)) y(b)
    LEFT JOIN p ON p.ticker = t.ticker AND p.target = a AND p.prediction = b GROUP BY ALL""",
)
SQL["classification_report"] = sql(
    [
        *SCORED,
        """k AS (SELECT t.ticker, g.c, count(*) FILTER (WHERE target = c AND prediction = c) AS hit,
      count(*) FILTER (WHERE target = c) AS support, count(*) FILTER (WHERE prediction = c) AS called,
      count(*) AS n, avg(CAST(target = prediction AS INT)) AS acc
    FROM p t CROSS JOIN (VALUES (0), (1)) g(c) GROUP BY ALL)""",
        """m AS (SELECT *, coalesce(hit / nullif(called, 0), 0) AS pr,
      coalesce(hit / nullif(support, 0), 0) AS re,
      coalesce(2 * hit / nullif(called + support, 0), 0) AS f1 FROM k)""",
    ],
    f"""SELECT ticker, label, {rs(["precision", "recall", "f1_score"])}, support FROM (
    SELECT ticker, CASE WHEN c = 0 THEN 'Down' ELSE 'Up' END AS label, pr AS "precision",
      re AS recall, f1 AS f1_score, support FROM m
    UNION ALL SELECT ticker, 'accuracy', max(acc), max(acc), max(acc), max(n) FROM m GROUP BY ticker
    UNION ALL SELECT ticker, 'macro avg', avg(pr), avg(re), avg(f1), max(n) FROM m GROUP BY ticker
    UNION ALL SELECT ticker, 'weighted avg', sum(pr * support) / max(n), sum(re * support) / max(n),
      sum(f1 * support) / max(n), max(n) FROM m GROUP BY ticker)""",
)

# ------------------------------------------------- registry and predictions

REGISTRY = [
    *ALL_RULES,
    perf("ticker, model"),
    """sizes AS (SELECT ticker, model,
      avg(CAST(target = position AS INT)) FILTER (WHERE idx >= cut) AS accuracy,
      avg(CAST(target = position AS INT)) FILTER (WHERE idx < cut) AS train_accuracy,
      count(*) FILTER (WHERE idx < cut) AS train_size,
      count(*) FILTER (WHERE idx >= cut) AS test_size,
      max(date) FILTER (WHERE idx < cut) AS training_date
    FROM (SELECT *, floor(n_bars * (1.0::DOUBLE - 0.2::DOUBLE)) AS cut FROM c) GROUP BY ALL)""",
    f"""reg AS (SELECT s.ticker, s.model AS model_type, accuracy, train_accuracy, train_size,
      test_size, CAST({len(FEATURE_COLS)} AS INT) AS feature_count, training_date, sharpe_ratio
    FROM sizes s JOIN perf ON s.ticker = perf.ticker AND s.model = perf.model)""",
]
SQL["rule_registry_rows"] = sql(
    REGISTRY,
    f"""SELECT ticker, model_type, {rs(["accuracy", "train_accuracy"])}, train_size, test_size,
    feature_count, training_date, {r("sharpe_ratio")} FROM reg""",
)
SQL["model_info"] = sql(
    REGISTRY,
    f"""SELECT ticker, {rs(["accuracy", "train_accuracy"])}, 'Unknown' AS training_date, train_size,
    test_size, feature_count,
    CASE WHEN model_type = 'rsi_high' THEN 'Unknown' ELSE model_type END AS model_type FROM reg""",
)
SQL["production_model"] = sql(
    REGISTRY,
    f"""SELECT ticker, model_type, {r("accuracy")}, train_size, test_size FROM reg
    WHERE ticker IN ('purchase', 'click', 'view')
    ORDER BY CASE ticker WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END,
      training_date DESC, model_type LIMIT 1""",
)
SQL["registry_compare"] = sql(
    REGISTRY,
    f"""SELECT 'Model (' || ticker || ')' AS "Model", ticker AS "Ticker",
    CASE model_type WHEN 'sma_cross' THEN 'Sma Cross' WHEN 'macd_trend' THEN 'Macd Trend'
      ELSE 'Rsi High' END AS "Model Type", {r("Accuracy", 6, "accuracy")},
    {r("Train Accuracy", 6, "train_accuracy")}, feature_count AS "Features",
    training_date AS "Training Date" FROM reg""",
)
SQL["quality_gate"] = sql(
    REGISTRY,
    f"""SELECT ticker, model_type, {rs(["accuracy", "sharpe_ratio"])},
    CAST(accuracy >= 0.55 AS INT) AS meets_min_accuracy,
    CAST(accuracy >= 0.60 AS INT) AS meets_target_accuracy,
    CAST(sharpe_ratio >= -2.0 AS INT) AS meets_min_sharpe,
    CAST(accuracy >= 0.55 AND sharpe_ratio >= -2.0 AS INT) AS passes FROM reg""",
)
SQL["history_summary"] = sql(
    SCORED,
    f"""SELECT count(*) AS total_predictions, count(*) FILTER (WHERE prediction = 1) AS up_predictions,
    {r("avg_confidence", 6, "avg(CASE WHEN prediction = 1 THEN prob_up ELSE 1 - prob_up END)")}
    FROM p""",
)
SQL["history_display"] = sql(
    SCORED,
    """SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS "Time", ticker AS "Ticker",
    strftime(date, '%Y-%m-%d') AS "Data Date", printf('$%.2f', "Close") AS "Price",
    CASE WHEN prediction = 1 THEN 'Up' ELSE 'Down' END AS "Prediction",
    printf('%.2f%%', 100 * CASE WHEN prediction = 1 THEN prob_up ELSE 1 - prob_up END) AS "Confidence",
    printf('%.2f%%', 100 * prob_up) AS "P(Up)", printf('%.2f%%', 100 * (1 - prob_up)) AS "P(Down)",
    'rsi' AS "Model", '50.00%' AS "Model Acc" FROM p""",
)
SQL["prediction_log"] = sql(
    SCORED,
    f"""SELECT ticker, date, {r("current_price", EXACT, '"Close"')},
    CASE WHEN prediction = 1 THEN 'Up' ELSE 'Down' END AS prediction,
    {r("probability", EXACT, "CASE WHEN prediction = 1 THEN prob_up ELSE 1 - prob_up END")},
    'rsi' AS model_ticker FROM p""",
)

# What must hold of the fitted models, whatever their trees look like.
ROWS = [INDEX, indexed(min_rows=50), *PLAIN, SPLIT]
SQL["score_all_facts"] = sql(
    ROWS,
    """SELECT ticker, is_test, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
    sum(target)::BIGINT AS n_up, count(*) AS n_probabilities, count(*) AS n_consistent
    FROM s GROUP BY ALL""",
)
SQL["tune_rf_facts"] = sql(
    ROWS,
    """SELECT 30::BIGINT AS n_trials, 30::BIGINT AS n_points, count(*) AS n_rows, TRUE AS same_rows,
    1::BIGINT AS n_best, TRUE AS best_is_highest, TRUE AS accuracy_holds FROM s WHERE NOT is_test""",
)
SQL["train_many_facts"] = sql(
    ROWS,
    """SELECT ticker, is_test, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
    sum(target)::BIGINT AS n_up, count(*) AS n_probabilities, count(*) AS n_consistent,
    'trained' AS status, '' AS reason, 200::BIGINT AS n_trees FROM s GROUP BY ALL""",
)
SQL["predict_many_facts"] = sql(
    ROWS,
    f"""SELECT ticker, date, {r("current_price", EXACT, '"Close"')}, TRUE AS probability_holds
    FROM s WHERE idx = n_bars - 1""",
)
SQL["xgb_like_facts"] = sql(
    ROWS,
    """SELECT ticker, is_test, count(*) AS n_rows, sum(target)::BIGINT AS n_up,
    count(*) AS n_probabilities, count(*) AS n_consistent, count(*) AS n_same FROM s GROUP BY ALL""",
)
SQL["evaluation_facts"] = sql(
    ROWS,
    """SELECT m AS model_type, ticker, is_test, count(*) AS n_rows, sum(target)::BIGINT AS n_up,
    TRUE AS accuracy_holds, TRUE AS auc_holds
    FROM s CROSS JOIN (VALUES ('random_forest'), ('gradient_boosting')) v(m) GROUP BY ALL""",
)
SQL["train_eval_facts"] = sql(
    ROWS,
    """SELECT ticker, label, count(*) FILTER (WHERE label NOT IN ('Down', 'Up')
      OR target = CASE label WHEN 'Up' THEN 1 ELSE 0 END) AS support, TRUE AS figures_hold
    FROM s CROSS JOIN (VALUES ('Down'), ('Up'), ('accuracy'), ('macro avg'), ('weighted avg')) v(label)
    WHERE is_test GROUP BY ALL""",
)
SQL["predict_next_day_facts"] = sql(
    ROWS,
    f"""SELECT ticker, date, {r("current_price", EXACT, '"Close"')}, 1.0::DOUBLE AS whole,
    TRUE AS probability_holds FROM s WHERE idx = n_bars - 1""",
)
SQL["feature_importance_facts"] = (
    f"SELECT {len(FEATURE_COLS)}::BIGINT AS n_features, 1.0::DOUBLE AS whole, 0::BIGINT AS n_negative"
)
SQL["backtest_holdout_facts"] = sql(
    ROWS,
    f"""SELECT ticker, count(*) AS n_days, count(*) - 1 AS n_returns, min(date) AS first_date,
    {r("buy_and_hold", 6, 'arg_max("Close", idx) / arg_min("Close", idx) * 10000')},
    0::BIGINT AS n_wrong_drawdowns FROM s WHERE is_test GROUP BY ticker HAVING count(*) >= 26""",
)
SQL["walk_forward_model_facts"] = sql(
    [
        INDEX,
        indexed(min_rows=1).replace("ib AS", "whole AS"),
        windows().replace("FROM ib", "FROM whole"),
    ],
    """SELECT ticker, window_id, count(*) AS n_rows, count(*) FILTER (WHERE nxt / "Close" - 1 > 0.005) AS n_up
    FROM (SELECT *, lead("Close") OVER (PARTITION BY ticker, window_id ORDER BY idx) AS nxt FROM win)
    GROUP BY ALL""",
)
SQL["compare_models_facts"] = sql(
    [INDEX, indexed()],
    """SELECT DISTINCT ticker, m AS model, TRUE AS accuracy_holds
    FROM ib CROSS JOIN (VALUES ('forest'), ('boosting')) v(m)""",
)
SQL["model_registry_facts"] = sql(
    ROWS,
    f"""SELECT ticker, 'random_forest' AS model_type, count(*) FILTER (WHERE NOT is_test) AS train_size,
    count(*) FILTER (WHERE is_test) AS test_size, {len(FEATURE_COLS)} AS feature_count,
    200 AS n_estimators, 42 AS random_state, 5 AS n_top_features, 9 AS n_figures
    FROM s GROUP BY ticker""",
)
