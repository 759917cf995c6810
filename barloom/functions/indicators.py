"""Technical indicators as staged window expressions.

A stage adds all its columns over one window specification, so Catalyst keeps
one exchange and one sort.  Only the columns asked for, and what they are
computed from, enter the plan.
Frames are partial at the start of a series: a 20-bar mean of 3 bars is the
mean of those 3.
"""

from __future__ import annotations

import re

from barloom.functions.ema import ema_sums, ema_value
from barloom.functions.maths import TINY
from barloom.operators.panel import BLOCK_ROWS, Panel

# The model's feature columns, in the order models expect them.
FEATURE_COLS = [
    "pct_change_1",
    "pct_change_2",
    "pct_change_3",
    "sma_5",
    "sma_10",
    "sma_20",
    "close_to_sma5",
    "close_to_sma10",
    "close_to_sma20",
    "rsi",
    "rolling_std_10",
    "volume_zscore",
    "hl_range",
    "hl_range_5",
    "price_position",
    "macd",
    "macd_signal",
    "macd_histogram",
    "bb_width",
    "bb_position",
    "momentum_5",
    "momentum_10",
    "roc_5",
    "roc_10",
    "close_to_ema5",
    "close_to_ema10",
    "close_to_ema20",
    "volume_ratio",
    "volume_price_trend",
    "atr_14",
    "volatility_5",
    "volatility_10",
    "volatility_20",
    "higher_high",
    "lower_low",
    "gap_up",
    "gap_down",
    "adx",
    "trend_strength",
]

# Periods of the indicators.
RSI_PERIOD = 14
ATR_PERIOD = 14
ADX_PERIOD = ATR_PERIOD  # the directional index divides by the same range
TARGET_THRESHOLD = 0.005

# Intermediate columns that are useful on their own.
HELPER_COLS = [
    "volume_sma_10",
    "bb_middle",
    "bb_upper",
    "bb_lower",
    "ema_5",
    "ema_10",
    "ema_20",
]

_ONE_AVERAGE = {
    "macd",
    "ema_5",
    "ema_10",
    "ema_20",
    "close_to_ema5",
    "close_to_ema10",
    "close_to_ema20",
}
_AVERAGE_OF_AVERAGE = {"macd_signal", "macd_histogram"}


def look_back(columns, rsi_period: int = RSI_PERIOD) -> int:
    """Rows before a block boundary that the columns depend on."""
    wanted = set(columns)
    if wanted & _AVERAGE_OF_AVERAGE:
        return max(2 * BLOCK_ROWS, rsi_period + 1)
    if wanted & _ONE_AVERAGE:
        return max(BLOCK_ROWS, rsi_period + 1)
    # Deepest finite chain: previous bar, 14 bars, 14 bars.
    return max(1 + ATR_PERIOD + ADX_PERIOD, rsi_period + 1)


def uses_average(columns) -> bool:
    return bool(set(columns) & (_ONE_AVERAGE | _AVERAGE_OF_AVERAGE))


def _stages(panel: Panel, rsi_period: int) -> list[dict[str, str]]:
    """Column name -> SQL text, one dictionary per level of windows."""
    row, last = panel.row_sql(), panel.last_sql
    tiny = f"{TINY!r}D"

    def mean(x: str, n: int) -> str:
        # For columns that are never NULL: the number of rows in the frame is
        # known, so the window only has to add up.
        return f"sum({x}) OVER {last(n)} / least(idx + 1, {n})"

    windows_1 = {f"_c{k}": f"lag(Close, {k}) OVER {row}" for k in (1, 2, 3, 5, 10)}
    windows_1 |= {"_h1": f"lag(High, 1) OVER {row}", "_l1": f"lag(Low, 1) OVER {row}"}
    windows_1 |= {f"sma_{n}": mean("Close", n) for n in (5, 10, 20)}
    windows_1 |= {
        "rolling_std_10": f"stddev_samp(Close) OVER {last(10)}",
        "_std20": f"stddev_samp(Close) OVER {last(20)}",
        "volume_sma_10": mean("Volume", 10),
        "_volume_sma_20": mean("Volume", 20),
        "_oldest10": f"first(Close) OVER {last(10)}",
    }
    for span in (5, 10, 12, 20, 26):
        windows_1 |= ema_sums(panel, "Close", span, f"e{span}")

    averages = {f"ema_{n}": ema_value(panel, n, f"e{n}") for n in (5, 10, 12, 20, 26)}

    up, down = "(High - _h1)", "(_l1 - Low)"
    values_1 = {
        "pct_change_1": "try_divide(Close, _c1) - 1D",
        "pct_change_2": "try_divide(Close, _c2) - 1D",
        "pct_change_3": "try_divide(Close, _c3) - 1D",
        "momentum_5": "try_divide(Close, _c5) - 1D",
        "momentum_10": "try_divide(Close, _c10) - 1D",
        "roc_5": "try_divide(Close - _c5, _c5) * 100D",
        "roc_10": "try_divide(Close - _c10, _c10) * 100D",
        # The first bar has no step; it counts as neither gain nor loss.
        "_gain": "CASE WHEN Close > _c1 THEN Close - _c1 ELSE 0D END",
        "_loss": "CASE WHEN Close < _c1 THEN _c1 - Close ELSE 0D END",
        "hl_range": "try_divide(High - Low, Close)",
        "price_position": f"try_divide(Close - Low, High - Low + {tiny})",
        "_true_range": "greatest(High - Low, abs(High - _c1), abs(Low - _c1))",
        "_plus_move": f"CASE WHEN {up} > {down} AND {up} > 0D THEN {up} ELSE 0D END",
        "_minus_move": f"CASE WHEN {down} > {up} AND {down} > 0D THEN {down} ELSE 0D END",
        "macd": "ema_12 - ema_26",
        "bb_middle": "sma_20",
        "bb_upper": "sma_20 + 2D * _std20",
        "bb_lower": "sma_20 - 2D * _std20",
        "higher_high": "coalesce(CAST(High > _h1 AS INT), 0)",
        "lower_low": "coalesce(CAST(Low < _l1 AS INT), 0)",
        "gap_up": "coalesce(CAST(Open > _c1 AS INT), 0)",
        "gap_down": "coalesce(CAST(Open < _c1 AS INT), 0)",
        "trend_strength": "signum(Close - _oldest10)",
        "volume_zscore": "try_divide(Volume - volume_sma_10, volume_sma_10)",
        "volume_ratio": "try_divide(Volume, _volume_sma_20)",
    }
    for n in (5, 10, 20):
        values_1[f"close_to_sma{n}"] = f"try_divide(Close, sma_{n}) - 1D"
        values_1[f"close_to_ema{n}"] = f"try_divide(Close, ema_{n}) - 1D"

    windows_2 = {
        "_gain_avg": mean("_gain", rsi_period),
        "_loss_avg": mean("_loss", rsi_period),
        "hl_range_5": f"avg(hl_range) OVER {last(5)}",
        "volume_price_trend": f"sum(Volume * pct_change_1) OVER {last(5)}",
        "atr_14": f"avg(_true_range) OVER {last(ATR_PERIOD)}",
        "_plus_avg": mean("_plus_move", ADX_PERIOD),
        "_minus_avg": mean("_minus_move", ADX_PERIOD),
        **{f"volatility_{n}": f"stddev_samp(pct_change_1) OVER {last(n)}" for n in (5, 10, 20)},
        **ema_sums(panel, "macd", 9, "signal"),
    }
    plus, minus = (f"100D * try_divide({m}, atr_14)" for m in ("_plus_avg", "_minus_avg"))
    values_2 = {
        "rsi": f"100D - 100D / (1D + _gain_avg / (_loss_avg + {tiny}))",
        "bb_width": "try_divide(bb_upper - bb_lower, bb_middle)",
        "bb_position": f"try_divide(Close - bb_lower, bb_upper - bb_lower + {tiny})",
        "macd_signal": ema_value(panel, 9, "signal"),
        "_dx": f"100D * try_divide(abs({plus} - {minus}), {plus} + {minus} + {tiny})",
    }
    windows_3 = {"adx": f"avg(_dx) OVER {last(ADX_PERIOD)}"}
    values_3 = {"macd_histogram": "macd - macd_signal"}
    return [windows_1, averages, values_1, windows_2, values_2, windows_3, values_3]


def needed(stages: list[dict[str, str]], columns) -> set[str]:
    """The columns and everything they are computed from."""
    wanted = set(columns)
    for stage in reversed(stages):
        for name in [n for n in stage if n in wanted]:
            wanted |= set(re.findall(r"\w+", stage[name]))
    return wanted


def add_indicators(panel: Panel, columns=tuple(FEATURE_COLS), rsi_period: int = RSI_PERIOD) -> Panel:
    """Add the indicator columns; NULL where the history is too short."""
    stages = _stages(panel, rsi_period)
    wanted = needed(stages, columns)
    for stage in stages:
        chosen = {n: text for n, text in stage.items() if n in wanted}
        if chosen:
            panel = panel.add_sql(chosen)
    return panel


def add_target(panel: Panel, threshold: float = TARGET_THRESHOLD) -> Panel:
    """Next close and whether it is more than ``threshold`` higher.

    The last bar of a series has no next close; its label is 0.
    """
    panel = panel.add_sql({"next_close": f"lead(Close, 1) OVER {panel.row_sql()}"})
    panel = panel.add_sql({"next_pct_change": "try_divide(next_close - Close, Close)"})
    up = f"coalesce(CAST(next_pct_change > {float(threshold)!r}D AS INT), 0)"
    return panel.add_sql({"target": up})
