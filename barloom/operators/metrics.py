"""Classification metrics and distributions, per series."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.maths import ratio
from barloom.operators.backtest import EXTREMES
from barloom.operators.panel import attach_stats

# Score buckets for the rank statistic; a bound on the rows one task sees when
# the buckets of a series are summed up, not a limit on the scores.
SCORE_BUCKETS = 65536
HISTOGRAM_BINS = 50


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def confusion_counts(actual: str = "target", predicted: str = "prediction") -> list[Column]:
    """Aggregates ``tn, fp, fn, tp``."""
    y, p = F.col(actual), F.col(predicted)
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def class_figures() -> list[Column]:
    """Accuracy, precision, recall and F1 out of the counts, and the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        _or_zero(ratio(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        _or_zero(ratio(tp, tp + fp)).alias("precision"),
        _or_zero(ratio(tp, tp + fn)).alias("recall"),
        _or_zero(ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn)).alias("f1_score"),
        tn,
        fp,
        fn,
        tp,
    ]


def confusion_matrix(
    scored: DataFrame, by=("ticker",), actual: str = "target", predicted: str = "prediction"
) -> DataFrame:
    """Counts ``tn, fp, fn, tp`` per series; always all four."""
    return scored.groupBy(*by).agg(*confusion_counts(actual, predicted))


def confusion_rows(scored: DataFrame, by=("ticker",), actual="target", predicted="prediction"):
    """The same counts as rows ``(actual, predicted, n)``."""
    cells = ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    entries = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
        for a, p, n in cells
    ]
    counts = confusion_matrix(scored, by, actual, predicted)
    return counts.select(*by, F.inline(F.array(*entries)))


def class_metrics(
    scored: DataFrame,
    by=("ticker",),
    actual: str = "target",
    predicted: str = "prediction",
    score: str | None = None,
) -> DataFrame:
    """Accuracy, precision, recall, F1 and the confusion counts.

    With ``score`` the exact ROC AUC is added, in the same pass over the rows.
    """
    if score is None:
        return confusion_matrix(scored, by, actual, predicted).select(*by, *class_figures())
    counts = _rank_area(scored, by, actual, score, confusion_counts(actual, predicted))
    return counts.select(*by, *class_figures(), "roc_auc")


def roc_auc(
    scored: DataFrame, by=("ticker",), actual: str = "target", score: str = "prob_up"
) -> DataFrame:
    """Exact area under the ROC curve; 0.0 where only one class occurs."""
    return _rank_area(scored, by, actual, score, [])


COUNT_NAMES = ("tn", "fp", "fn", "tp")


def _rank_area(scored: DataFrame, by, actual: str, score: str, counts: list[Column]) -> DataFrame:
    """``roc_auc`` per series, with further counts summed up on the way.

    The area counts, for every positive, the negatives with a lower score and
    half of those with the same score.  Rows are first reduced to counts per
    distinct score, ranked inside score buckets, and the buckets are then put
    together by a running sum: no task ever ranks a whole series.
    The buckets divide the range of the scores that a series really has.  Rows
    without a score (NULL or NaN) have no rank and take no part in the area;
    they do count in the confusion counts.
    """
    by = list(by)
    kept = COUNT_NAMES[: len(counts)]
    value = F.col(score).cast("double")
    tally = scored.groupBy(*by, F.when(~F.isnan(value), value).alias("_score")).agg(
        F.count_if(F.col(actual) == 1).alias("_pos"),
        F.count_if(F.col(actual) == 0).alias("_neg"),
        *counts,
    )
    ranked = F.col("_score").isNotNull()
    tally = tally.withColumns(
        {c: F.when(ranked, F.col(c)).otherwise(F.lit(0)) for c in ("_pos", "_neg")}
    )
    bounds = tally.groupBy(*by).agg(F.min("_score").alias("_lo"), F.max("_score").alias("_hi"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    bounds = bounds.withColumnsRenamed({c: f"_of_{c}" for c in by})
    # One row per series; without a series, one row in all.
    tally = tally.join(bounds, functools.reduce(operator.and_, same)) if by else tally.join(F.broadcast(bounds))
    # Halved first, so that the width of a very wide range is still a number.
    place = ratio(F.col("_score") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    slot = F.when(place.between(0.0, 1.0), F.floor(place * F.lit(SCORE_BUCKETS - 1)))
    top = F.when(place > 0, F.lit(SCORE_BUCKETS - 1)).otherwise(F.lit(0)).cast("bigint")
    tally = tally.withColumn("_slot", F.coalesce(slot, top))
    inside = Window.partitionBy(*by, "_slot").orderBy("_score")
    below = F.coalesce(
        F.sum("_neg").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    tally = tally.withColumn("_wins", F.col("_pos").cast("double") * (below + F.col("_neg") / F.lit(2.0)))
    slots = tally.groupBy(*by, "_slot").agg(
        *[F.sum(c).alias(c) for c in ("_pos", "_neg", "_wins", *kept)]
    )
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_below", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)))
    area = F.sum(F.col("_wins") + F.col("_pos").cast("double") * F.col("_below").cast("double"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return slots.groupBy(*by).agg(
        _or_zero(ratio(area, pairs)).alias("roc_auc"), *[F.sum(c).alias(c) for c in kept]
    )


def classification_report(
    scored: DataFrame, by=("ticker",), actual: str = "target", predicted: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class and averaged, as rows."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = confusion_matrix(scored, by, actual, predicted)

    def one_class(hit, false_alarm, miss):
        return (
            _or_zero(ratio(hit, hit + false_alarm)),
            _or_zero(ratio(hit, hit + miss)),
            _or_zero(ratio(F.lit(2) * hit, F.lit(2) * hit + false_alarm + miss)),
        )

    down, up = one_class(tn, fn, fp), one_class(tp, fp, fn)
    n_down, n_up = tn + fp, tp + fn
    n = n_down + n_up
    macro = [(d + u) / F.lit(2.0) for d, u in zip(down, up)]
    weighted = [_or_zero(ratio(d * n_down + u * n_up, n)) for d, u in zip(down, up)]
    accuracy = _or_zero(ratio(tp + tn, n))

    def line(label, values, support):
        names = ("precision", "recall", "f1_score")
        return F.struct(
            F.lit(label).alias("label"),
            *[v.alias(name) for v, name in zip(values, names)],
            support.alias("support"),
        )

    lines = F.array(
        line("Down", down, n_down),
        line("Up", up, n_up),
        line("accuracy", [accuracy] * 3, n),
        line("macro avg", macro, n),
        line("weighted avg", weighted, n),
    )
    return counts.select(*by, F.inline(lines))


def label_distribution(labelled: DataFrame, by=("ticker",), label: str = "target") -> DataFrame:
    return labelled.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def returns_histogram(curve: DataFrame, by=("ticker",), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts of ``returns`` in equal-width bins between its extremes.

    A curve that carries the extremes of its series (``equity_curve`` with
    ``extremes``) is read once, and a partial aggregate is all that is shuffled;
    of any other the extremes are found by a reading of their own.
    """
    r = F.col("returns")
    rows = curve.filter(r.isNotNull())
    if set(EXTREMES) <= set(curve.columns):
        rows = rows.withColumnsRenamed(dict(zip(EXTREMES, ("_lo", "_hi"))))
    else:
        bounds = rows.groupBy(*by).agg(
            F.min(r).alias("_lo"), F.max(r).alias("_hi"), F.max("n_bars").alias("n_bars")
        )
        rows = attach_stats(rows, bounds, by)
    lo, width = F.col("_lo"), F.col("_hi") - F.col("_lo")
    # A constant series has no width; all of it falls into the first bin.
    place = F.coalesce(F.floor(ratio(r - lo, width) * F.lit(bins)), F.lit(0).cast("bigint"))
    counted = (
        rows.withColumn("bin", F.least(place, F.lit(bins - 1).cast("bigint")))
        .groupBy(*by, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edge = lambda k: lo + width * k / F.lit(float(bins))
    return counted.select(
        *by,
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        "n",
    )
