import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics
from barloom.operators.training_set import (
    class_weights,
    scale_features,
    time_split,
    with_folds,
)

SCORED = "ticker string, target int, prediction int, prob_up double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCORED)


def pairwise_auc(rows):
    up = [r[3] for r in rows if r[1] == 1]
    down = [r[3] for r in rows if r[1] == 0]
    if not up or not down:
        return 0.0
    won = sum((u > d) + 0.5 * (u == d) for u in up for d in down)
    return won / (len(up) * len(down))


@pytest.mark.parametrize("digits", [1, 3, 15])
def test_auc_counts_pairs(spark, digits):
    rng = random.Random(digits)
    rows = []
    for t in ("A", "B"):
        for _ in range(150):
            y = rng.randint(0, 1)
            rows.append((t, y, rng.randint(0, 1), round(rng.random() * 0.7 + 0.3 * y, digits)))
    rows += [("A", 1, 1, 1.0), ("A", 0, 0, 0.0), ("B", 0, 1, 1.0)]
    got = {r["ticker"]: r["roc_auc"] for r in metrics.roc_auc(frame(spark, rows)).collect()}
    for t in got:
        assert abs(got[t] - pairwise_auc([r for r in rows if r[0] == t])) < 1e-12


def test_auc_outside_the_unit_interval(spark):
    rows = [("A", i % 2, 0, float(x)) for i, x in enumerate([-5, 3, 2, 9, -7, 9, 9, -1])]
    got = metrics.roc_auc(frame(spark, rows)).first()["roc_auc"]
    assert abs(got - pairwise_auc(rows)) < 1e-12


def test_auc_without_scores(spark):
    nan = float("nan")
    rows = [("A", 1, 1, 0.9), ("A", 1, 0, 0.4), ("A", 0, 0, 0.4), ("A", 0, 0, 0.1), ("A", 1, 1, None), ("A", 0, 0, nan)]
    row = metrics.class_metrics(frame(spark, rows), score="prob_up").first()
    assert abs(row["roc_auc"] - pairwise_auc(rows[:4])) < 1e-12
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == 6
    assert metrics.roc_auc(frame(spark, [("A", 1, 1, None), ("A", 0, 0, None)])).first()["roc_auc"] == 0.0


@pytest.mark.parametrize("scale", [1e-300, 100.0, 1e308])
def test_auc_of_scores_of_any_size(spark, scale):
    rows = [("A", i % 2, 0, x * scale) for i, x in enumerate([-0.9, 0.3, 0.2, 0.9, -0.7, 0.9, 0.9, -0.1])]
    assert abs(metrics.roc_auc(frame(spark, rows)).first()["roc_auc"] - pairwise_auc(rows)) < 1e-12


def test_one_class(spark):
    df = frame(spark, [("A", 0, 0, 0.2), ("A", 0, 0, 0.4)])
    row = metrics.class_metrics(df, score="prob_up").first()
    assert row["roc_auc"] == 0.0 and row["accuracy"] == 1.0
    assert row["precision"] == row["recall"] == row["f1_score"] == 0.0
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 0, 0)
    assert metrics.confusion_rows(df).count() == 4


def test_pooled_metrics(spark):
    df = frame(spark, [("A", 1, 1, 0.9), ("B", 0, 1, 0.8), ("B", 0, 0, 0.1)])
    row = metrics.class_metrics(df, (), score="prob_up").first()
    assert row["tp"] == 1 and row["fp"] == 1 and row["roc_auc"] == 1.0


def test_report_averages(spark):
    df = frame(spark, [("A", 1, 1, 0.9), ("A", 1, 0, 0.4), ("A", 0, 1, 0.6), ("A", 0, 0, 0.1)] * 3
               + [("A", 0, 0, 0.2)])
    rows = {r["label"]: r for r in metrics.classification_report(df).collect()}
    up, down = rows["Up"], rows["Down"]
    assert (up["precision"], up["recall"], up["support"]) == (0.5, 0.5, 6)
    assert abs(down["precision"] - 4 / 7) < 1e-12 and abs(down["recall"] - 4 / 7) < 1e-12
    assert abs(rows["macro avg"]["precision"] - (0.5 + 4 / 7) / 2) < 1e-12
    assert abs(rows["weighted avg"]["recall"] - (0.5 * 6 + 4 / 7 * 7) / 13) < 1e-12
    assert abs(rows["accuracy"]["f1_score"] - 7 / 13) < 1e-12


def curve(spark, values):
    rows = [("A", i, len(values), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, idx bigint, n_bars bigint, returns double")


def test_histogram(spark):
    rng = random.Random(3)
    values = [None] + [rng.gauss(0, 1) for _ in range(400)]
    rows = metrics.returns_histogram(curve(spark, values), bins=7).collect()
    known = values[1:]
    lo, width = min(known), max(known) - min(known)
    expected = {}
    for v in known:
        k = min(int((v - lo) / width * 7), 6)
        expected[k] = expected.get(k, 0) + 1
    assert {r["bin"]: r["n"] for r in rows} == expected


def test_histogram_of_a_constant(spark):
    rows = metrics.returns_histogram(curve(spark, [None, 0.5, 0.5])).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 2)]


def training_rows(spark):
    return spark.range(100).selectExpr(
        "'A' ticker", "date_add(date'2020-01-01', cast(id as int)) date", "id idx",
        "100L n_bars", "cast(id % 3 = 0 as int) target", "cast(id as double) x", "1D flat",
    )


def test_split_is_by_time(spark):
    split = time_split(training_rows(spark))
    assert split.filter("is_test").agg(F.min("idx"), F.count("*")).first() == (80, 20)


@pytest.mark.parametrize("by", [("ticker",), ()])
def test_scaling_uses_train_rows_only(spark, by):
    out = scale_features(time_split(training_rows(spark)), ("x", "flat"), by)
    mean, sd = out.filter("not is_test").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(mean) < 1e-12 and abs(sd - 1) < 1e-12
    assert out.filter("flat <> 0").count() == 0
    assert out.filter("is_test").agg(F.min("x")).first()[0] > 1.7


def test_class_weights_balance(spark):
    rows = class_weights(training_rows(spark)).collect()
    assert all(abs(r["weight"] * r["n_class"] - 50) < 1e-12 for r in rows)


def test_folds_are_contiguous_per_class(spark):
    rows = with_folds(training_rows(spark)).orderBy("date").collect()
    for y in (0, 1):
        folds = [r["fold"] for r in rows if r["target"] == y]
        assert folds == sorted(folds) and set(folds) == {0, 1, 2}
        sizes = [folds.count(k) for k in range(3)]
        assert max(sizes) - min(sizes) <= 1
