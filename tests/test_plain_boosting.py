import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from barloom.ml import plain_boosting, training
from barloom.ml.boosting import BoostedModel, _rows_of, edges_of, pack_rows
from barloom.ml.growth import Shape, grow, in_round
from barloom.ml.registry import load_model, save_model
from barloom.ml.scoring import score
from barloom.ml.training import feature_importance, fit_classifier

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    """Columns of eight values, so that each has a bin, in Spark's trees as well."""
    drawn = spark.range(3_000, numPartitions=3).select("id", *[F.floor(8 * F.rand(i)).cast("double").alias(c) for i, c in enumerate(COLUMNS)])
    signal = F.col("a") - 3.5 + (F.col("b") - 3.5) * (F.col("c") - 3.5) + 2 * F.randn(9)
    frame = drawn.withColumn("target", (signal > 0.2).cast("int")).cache()
    frame.count()
    yield frame
    frame.unpersist()


def chances(rows, model):
    return np.array([r["prob_up"] for r in score(rows, model).orderBy("id").select("prob_up").collect()])


def test_large_tables_are_boosted_here_saved_and_read(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(training, "FOREST_ROWS", 1_000)
    model = fit_classifier(rows, "gradient_boosting", 30, columns=COLUMNS)
    assert isinstance(model, BoostedModel) and model.getNumTrees == 30
    scored = score(rows, model)
    assert scored.filter("prediction = target").count() > 2_400
    assert scored.filter("prob_up BETWEEN 0 AND 1 AND prediction = int(prob_up > 0.5)").count() == 3_000
    assert abs(sum(r["importance"] for r in feature_importance(model, None).collect()) - 1) < 1e-9
    assert np.array_equal(chances(rows, load_model(save_model(model, str(tmp_path / "m")))), chances(rows, model))


def test_scores_are_those_of_sparks_boosting(rows, monkeypatch):
    """With all features and rows nothing is drawn, so the trees are the same ones."""
    options = dict(columns=COLUMNS, maxDepth=3, stepSize=0.2, subsamplingRate=1.0, featureSubsetStrategy="all", minInstancesPerNode=5)
    theirs = fit_classifier(rows, "gradient_boosting", 6, **options)
    monkeypatch.setattr(training, "FOREST_ROWS", 1_000)
    ours = fit_classifier(rows, "gradient_boosting", 6, **options)
    assert not isinstance(theirs, BoostedModel) and isinstance(ours, BoostedModel)
    assert np.allclose(chances(rows, ours), chances(rows, theirs), atol=1e-6)


@pytest.mark.parametrize("least,block,parts", [(5_000, 100_000, 64), (1_000, 10, 64), (400, 300, 2)])
def test_trees_of_any_parts_are_those_of_one_block(rows, monkeypatch, least, block, parts):
    monkeypatch.setattr(plain_boosting, "LEAST_ROWS", least)
    monkeypatch.setattr(plain_boosting, "BLOCK_ROWS", block)
    monkeypatch.setattr(plain_boosting, "PLAIN_PARTS", parts)
    monkeypatch.setattr(plain_boosting, "KEEP_EVERY", 2)
    estimator = GBTClassifier(maxIter=5, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=3)
    packed = pack_rows(rows, COLUMNS, edges_of(rows, COLUMNS))
    key, y, margin, bins = _rows_of(packed.toArrow().combine_chunks().to_batches()[0])
    want = []
    for number in range(5):
        n = in_round(key, 3, number, 0.8).astype(float)
        tree = grow(bins, 4 * (y - 1 / (1 + np.exp(-margin))), n, n, Shape(4, 2, per_node=2), np.random.default_rng([3, number]))
        margin = margin + tree.value[tree.route(bins)] * (0.2 if number else 1.0)
        want.append(margin)
    trees = plain_boosting._boost(plain_boosting._blocks(packed, 3_000, len(COLUMNS)), estimator, len(COLUMNS))
    got = np.cumsum([t.value[t.route(bins)] for t in trees], axis=0)
    assert len(trees) == 5 and np.allclose(got, want, atol=1e-9)


def test_one_task_grows_the_trees_of_all_jobs_without_a_job_per_level(spark, rows, monkeypatch):
    estimator = GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=3)

    def fit():
        group = f"alone-{plain_boosting.ALONE_ROWS}"
        spark.sparkContext.setJobGroup(group, group)
        model = plain_boosting.fit_boosting(rows, COLUMNS, estimator, 3_000)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return model, jobs

    alone, few = fit()
    monkeypatch.setattr(plain_boosting, "ALONE_ROWS", 0)
    together, many = fit()
    assert few < 12 < 32 <= many
    assert [len(t.feature) for t in alone.trees] == [len(t.feature) for t in together.trees]
    assert np.allclose(chances(rows, alone), chances(rows, together), atol=1e-9)


def test_a_table_of_some_thousand_rows_is_fitted_here(rows):
    more = rows.unionByName(rows)
    for kind in ("random_forest", "gradient_boosting"):
        assert isinstance(fit_classifier(more, kind, 2, columns=COLUMNS), BoostedModel)


def test_a_label_of_one_class_is_learned_as_such(rows):
    estimator = GBTClassifier(maxIter=2, maxDepth=2, seed=3)
    model = plain_boosting.fit_boosting(rows.withColumn("target", F.lit(1)), COLUMNS, estimator, 3_000)
    assert score(rows, model).filter("prob_up > 0.8 AND prediction = 1").count() == 3_000


def test_settings_that_are_not_known_are_left_to_spark():
    assert plain_boosting.is_boosted_here(training.make_classifier("gradient_boosting"))
    assert not plain_boosting.is_boosted_here(training.make_classifier("gradient_boosting", minInfoGain=0.1))
    assert not plain_boosting.is_boosted_here(training.make_classifier("random_forest"))
