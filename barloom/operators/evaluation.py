"""Performance and classification figures of a labelled curve, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.operators.backtest import perf_figures, perf_sums
from barloom.operators.metrics import class_figures, confusion_counts

COMPARED = ("accuracy", "sharpe_ratio", "total_return", "max_drawdown", "win_rate", "f1_score")


def evaluate_curve(
    curve: DataFrame, by=("ticker",), actual: str = "target", predicted: str = "position"
) -> DataFrame:
    """Both kinds of figures per series; the curve is aggregated once."""
    sums = curve.groupBy(*by).agg(*perf_sums(), *confusion_counts(actual, predicted))
    return sums.select(*by, *perf_figures(), *class_figures())


def compare_curves(curve: DataFrame, by=("ticker", "model"), predicted: str = "position"):
    """The comparison columns, one row per series and model."""
    return evaluate_curve(curve, by, predicted=predicted).select(*by, *COMPARED)
