import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from barloom.ml import boosting, forest, training
from barloom.ml.boosting import _rows_of, edges_of, pack_rows
from barloom.ml.growth import Shape, grow, times_drawn
from barloom.ml.registry import load_model, save_model
from barloom.ml.scoring import score
from barloom.ml.training import feature_importance, fit_classifier

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    drawn = spark.range(2_000, numPartitions=3).select("id", *[F.randn(i).alias(c) for i, c in enumerate(COLUMNS)])
    frame = drawn.withColumn("target", (F.col("a") + F.col("b") * F.col("c") + 0.3 * F.randn(9) > 0.2).cast("int")).cache()
    frame.count()
    yield frame
    frame.unpersist()


def test_nodes_split_by_aggregates_and_by_tasks_make_the_trees_of_one_block(rows, monkeypatch):
    """Whatever the size up to which a task grows a node, and in whatever batches, every tree is that of all its rows."""
    estimator = RandomForestClassifier(numTrees=5, maxDepth=7, minInstancesPerNode=2, featureSubsetStrategy="all", seed=3)
    bins_of = pack_rows(rows, COLUMNS, edges_of(rows, COLUMNS)).toArrow().combine_chunks().to_batches()[0]
    key, y, _, bins = _rows_of(bins_of)
    for node_rows, batch in ((150, 4_000), (10_000, 1 << 30), (1, 1 << 30)):
        monkeypatch.setattr(forest, "NODE_ROWS", node_rows)
        monkeypatch.setattr(forest, "BATCH_ROWS", batch)
        model = forest.fit_forest(rows, COLUMNS, estimator, 2_000)
        assert model.getNumTrees == 5
        for k, tree in enumerate(model.trees):
            n = times_drawn(key, 3, k, 1.0).astype(float)
            want = grow(bins, n * y, n, n, Shape(7, 2), np.random.default_rng(0))
            assert len(tree.feature) == len(want.feature)
            assert np.allclose(tree.value[tree.route(bins)], want.value[want.route(bins)], atol=1e-6)


@pytest.mark.parametrize("node_rows", [150, 10_000])
def test_trees_of_a_block_are_those_of_distributed_rows(rows, monkeypatch, node_rows):
    monkeypatch.setattr(forest, "NODE_ROWS", node_rows)
    packed = pack_rows(rows, COLUMNS, edges_of(rows, COLUMNS))
    key, y, _, bins = _rows_of(packed.toArrow().combine_chunks().to_batches()[0])
    order = np.random.default_rng(0).permutation(len(key))
    how = Shape(9, 2, per_node=2), 3, 0.8, (0.7, 1.9)
    for k, tree in enumerate(forest.grown_trees(packed, 2_000, 0, 4, *how, len(COLUMNS))):
        alone = forest.block_tree(key[order], y[order], bins[order], k, *how)
        assert all(np.array_equal(getattr(alone, name), getattr(tree, name)) for name in ("feature", "split", "child", "value", "gain"))
        assert len(tree.feature) > 50


def test_rows_of_a_tree_are_drawn_with_replacement():
    n = times_drawn(np.arange(200_000), 7, 0, 1.0)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02
    assert (n != times_drawn(np.arange(200_000), 7, 1, 1.0)).any()


def test_large_forests_are_grown_saved_and_read(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(training, "FOREST_ROWS", 1_000)
    monkeypatch.setattr(forest, "NODE_ROWS", 300)
    model = fit_classifier(rows, "random_forest", 20, columns=COLUMNS)
    assert isinstance(model, forest.ForestModel)
    scored = score(rows, model)
    assert scored.filter("prediction = target").count() > 1_800
    assert scored.filter("prob_up BETWEEN 0 AND 1 AND prediction = int(prob_up > 0.5)").count() == 2_000
    assert abs(sum(r["importance"] for r in feature_importance(model, None).collect()) - 1) < 1e-9
    monkeypatch.setattr(boosting, "PART_NODES", 500)
    again = load_model(save_model(model, str(tmp_path / "m")))
    assert len(list((tmp_path / "m" / "forest" / "trees").glob("*.parquet"))) > 1
    key = lambda m: {r["id"]: r["prob_up"] for r in score(rows, m).collect()}
    assert key(again) == key(model)


def test_settings_that_are_not_known_and_small_tables_are_left_to_spark(rows, monkeypatch):
    assert isinstance(fit_classifier(rows, "random_forest", 2, columns=COLUMNS, maxDepth=3), PipelineModel)
    monkeypatch.setattr(training, "FOREST_ROWS", 1_000)
    assert isinstance(fit_classifier(rows, "random_forest", 2, columns=COLUMNS, maxDepth=3, impurity="entropy"), PipelineModel)


def test_a_label_of_one_class_is_learned_as_such(rows, monkeypatch):
    monkeypatch.setattr(training, "FOREST_ROWS", 1_000)
    model = fit_classifier(rows.withColumn("target", F.lit(1)), "random_forest", 2, columns=COLUMNS)
    assert score(rows, model).filter("prob_up = 1").count() == 2_000
