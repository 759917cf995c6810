import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import FEATURE_COLS
from barloom.ml import registry, scoring, versions
from barloom.ml.training import (
    feature_importance,
    make_classifier,
    model_type_name,
    train_by_ticker,
    train_model,
    training_table,
)
from barloom.ml.tuning import SEARCH_SPACES, draw_params, tune_classifier
from barloom.plans import queries

from helpers import bars_frame, walk

SMALL = {"n_estimators": 3, "maxDepth": 4}


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk("A", 150, seed=31) + walk("B", 120, seed=32) + walk("TINY", 49, seed=33)
    return bars_frame(spark, rows).cache()


@pytest.fixture(scope="module")
def trained(bars):
    return train_model(bars, **SMALL)


def test_training_gate_and_split(bars):
    rows = training_table(bars, ("rsi",)).groupBy("ticker", "is_test").count().collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {
        ("A", False): 120, ("A", True): 30, ("B", False): 96, ("B", True): 24,
    }


def test_evaluation(trained):
    rows = trained.evaluation().collect()
    assert len(rows) == 4
    assert all(0 <= r["accuracy"] <= 1 and 0 <= r["roc_auc"] <= 1 for r in rows)
    assert trained.report().count() == 10


def test_holdout_needs_enough_rows(trained):
    assert [r["ticker"] for r in trained.holdout_metrics().collect()] == ["A"]


def test_save_and_load(trained, bars, tmp_path):
    uri = registry.save_model(trained.model, str(tmp_path / "model"))
    model = registry.load_model(uri)
    assert scoring.model_columns(model) == FEATURE_COLS
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(scoring.predict_next_day(bars, model)) == key(
        scoring.predict_next_day(bars, trained.model)
    )


def test_prediction_is_the_last_scored_row(trained, bars):
    got = {r["ticker"]: r for r in scoring.predict_next_day(bars, trained.model).collect()}
    assert set(got) == {"A", "B", "TINY"}
    last = trained.scored.filter("idx = n_bars - 1").collect()
    for row in last:
        p = got[row["ticker"]]
        assert p["date"] == row["date"] and abs(p["prob_up"] - row["prob_up"]) < 1e-9
        assert p["prediction"] == ("Up" if row["prediction"] == 1 else "Down")
        assert p["probability"] == pytest.approx(max(p["prob_up"], p["prob_down"]))


def test_missing_feature_columns(trained, bars):
    with pytest.raises(ValueError, match="lacks the columns"):
        scoring.score(bars, trained.model)


def test_importance(trained):
    rows = feature_importance(trained.model, None).collect()
    assert len(rows) == 39 and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert feature_importance(trained.model).count() == 10


def test_model_types():
    assert model_type_name("  XGBoost ") == "xgboost"
    with pytest.raises(ValueError, match="no model type 'svm'"):
        model_type_name("svm")
    assert make_classifier("random_forest").getMaxDepth() == 15
    assert make_classifier("gradient_boosting").getStepSize() == 0.05
    assert make_classifier("xgboost").getMinInstancesPerNode() == 3


def test_search_spaces():
    sizes = {k: len(draw_params(v, 10**9, 1)) for k, v in SEARCH_SPACES.items()}
    assert sizes == {"random_forest": 216, "xgboost": 2916, "gradient_boosting": 972}
    drawn = draw_params(SEARCH_SPACES["xgboost"], 30, 42)
    assert len({tuple(d.items()) for d in drawn}) == 30
    assert drawn == draw_params(SEARCH_SPACES["xgboost"], 30, 42)


def test_tuning(bars):
    table = training_table(bars).filter("not is_test")
    space = {"numTrees": [2, 3], "maxDepth": [2]}
    model, trials = tune_classifier(table, draws=2, folds=2, space=space)
    rows = trials.collect()
    assert len(rows) == 2 and sum(r["best"] for r in rows) == 1
    best = next(r for r in rows if r["best"])
    assert model.stages[-1].getNumTrees == int(best["params"]["numTrees"])


def test_failed_ticker_does_not_stop_the_rest(bars):
    done = train_by_ticker(bars, ["A", "NOBODY", "TINY"], **SMALL)
    assert list(done.models) == ["A"]
    rows = {r["ticker"]: (r["status"], r["reason"]) for r in done.outcome.collect()}
    assert rows == {
        "A": ("trained", ""),
        "NOBODY": ("not trained", "fewer than 50 bars"),
        "TINY": ("not trained", "fewer than 50 bars"),
    }


def test_errors_during_a_fit_are_not_swallowed(bars):
    with pytest.raises(Exception):
        train_by_ticker(bars, ["A"], n_estimators=3, maxDepth=99)


def test_finished_fits_are_kept_when_another_fails(bars, monkeypatch):
    from barloom.ml import training

    real, kept = training.train_model, []

    def sometimes(rows, **options):
        if rows.first()["ticker"] == "A":
            raise RuntimeError("no luck")
        return real(rows, **options)

    monkeypatch.setattr(training, "train_model", sometimes)
    both = bars.unionByName(bars.filter("ticker = 'A'").withColumn("ticker", F.lit("B")))
    with pytest.raises(RuntimeError, match="no luck"):
        train_by_ticker(both, ["A", "B"], keep=lambda name, _: kept.append(name), **SMALL)
    assert kept == ["B"]


def test_merged_log_holds_a_prediction_once(spark, trained, bars, tmp_path):
    path = str(tmp_path / "log")
    records = registry.prediction_records(
        scoring.predict_next_day(bars, trained.model), F.lit("A"), F.lit(0.5)
    ).withColumn("ticker", F.when(F.col("ticker") != "A", F.col("ticker")))
    with pytest.raises(ValueError):
        registry.read_history(spark, path)
    for _ in range(2):
        registry.merge_history(records, path)
    other = records.withColumn("model_ticker", F.lit("B"))
    registry.merge_history(other.unionByName(records).unionByName(other), path)
    assert registry.read_history(spark, path).count() == 2 * records.count()
    registry.compact_history(spark, path)
    registry.merge_history(records, path)
    folder = versions.served(spark, path)
    assert spark.read.parquet(folder).count() == registry.read_history(spark, path).count() == 2 * records.count()


def test_broken_publishing_leaves_what_was_served(spark, trained, tmp_path):
    place = str(tmp_path / "production")
    versions.publish(spark, place, lambda folder: registry.save_model(trained.model, folder))
    first = versions.served(spark, place)

    def broken(folder):
        registry.save_model(trained.model, folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.publish(spark, place, broken)
    assert versions.served(spark, place) == first and registry.load_model(place) is not None
    versions.publish(spark, place, lambda folder: registry.save_model(trained.model, folder))
    assert versions.served(spark, place) != first


def test_tuned_model_is_a_trained_model(bars):
    search = {"draws": 2, "folds": 2, "space": {"numTrees": [2, 4], "maxDepth": [2]}}
    tuned = train_model(bars, tune=True, search=search)
    best = next(r for r in tuned.trials.collect() if r["best"])
    rows = registry.registry_rows(tuned).collect()
    assert {r["n_estimators"] for r in rows} == {int(best["params"]["numTrees"])}
    assert tuned.evaluation().count() == 4 and tuned.holdout_metrics().count() == 1


def test_holdout_positions_follow_from_the_split(trained):
    rows = trained.holdout_curve().orderBy("date").collect()
    assert [r["idx"] for r in rows] == list(range(30)) and {r["n_bars"] for r in rows} == {30}


def test_compare_and_backtest(trained, bars):
    both = scoring.compare_models(bars, {"one": trained.model, "two": trained.model}).collect()
    assert len(both) == 6
    one = {r["ticker"]: tuple(r)[2:] for r in both if r["model"] == "one"}
    two = {r["ticker"]: tuple(r)[2:] for r in both if r["model"] == "two"}
    assert one == two
    tables = scoring.backtest_model(bars, trained.model, "2001-01-10", "2001-04-30")
    assert tables["daily"].filter("ticker = 'A'").count() == 111
    assert tables["performance"].count() == tables["classification"].count() == 3


def test_walk_forward(trained, bars):
    got = scoring.walk_forward_model(bars, trained.model, train=60, test=30, step=30)
    assert got.groupBy("ticker").count().filter("ticker = 'A'").first()["count"] == 3


def test_registry(spark, trained, tmp_path):
    when = dt.datetime(2024, 5, 1)
    rows = registry.registry_rows(trained, "file:/models/one", when)
    path = str(tmp_path / "registry")
    registry.append_registry(rows, path, "one")
    registry.append_registry(rows, path, "one")  # a retry replaces the rows of its run
    other = {
        "ticker": "AAPL",
        "accuracy": 0.75,
        "feature_count": 15,
        "training_date": dt.datetime(2024, 4, 1),
        "model_type": "random_forest",
    }
    registry.append_registry(spark.createDataFrame([other], registry.REGISTRY_SCHEMA), path, "two")
    table = registry.read_registry(spark, path)
    assert table.count() == 3
    a = table.filter("ticker = 'A'").first()
    assert (a["train_size"], a["test_size"], a["n_estimators"]) == (120, 30, 3)
    assert len(a["top_features"]) == 5 and len(a["backtest_metrics"]) == 9
    meta = table.filter("ticker = 'AAPL'").first()
    assert (meta["accuracy"], meta["feature_count"]) == (0.75, 15)
    assert registry.select_production(table, ["B", "A", "AAPL"]).first()["ticker"] == "AAPL"
    assert registry.select_production(table, ["B", "A"]).first()["ticker"] == "B"
    info = registry.model_info(table.filter("ticker = 'AAPL'")).first()
    assert info["train_accuracy"] == 0.0 and info["model_type"] == "random_forest"
    kinds = {r["Model Type"] for r in registry.registry_compare(table).collect()}
    assert "Random Forest" in kinds
    gate = registry.quality_gate(table).filter("ticker = 'AAPL'").first()
    assert (gate["meets_target_accuracy"], gate["meets_min_sharpe"], gate["passes"]) == (1, 0, 0)


def test_prediction_log(spark, trained, bars, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    records = registry.prediction_records(
        scoring.predict_next_day(bars, trained.model), F.lit("A"), F.lit(0.5)
    )
    registry.append_history(records, path)
    registry.append_history(records, path)
    assert spark.read.parquet(path).count() == 6
    registry.export_history(spark.read.parquet(path), out)
    assert spark.read.option("header", True).csv(out).count() == 6
    registry.clear_history(spark, path)
    assert spark.read.parquet(path).count() == 0
    assert "prob_down" in spark.read.parquet(path).columns


def test_queries_ask_for_the_whole_search_and_default_trees(spark, bars, monkeypatch):
    asked = {}

    class Asked(Exception):
        pass

    def note(name):
        def call(*args, **options):
            asked[name] = options
            raise Asked

        return call

    for name in ("train_model", "train_by_ticker"):
        monkeypatch.setattr(queries, name, note(name))
    for name in ("tune_rf", "train_by_ticker"):
        with pytest.raises(Asked):
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == {"train_model": {"tune": True}, "train_by_ticker": {}}


def test_large_fits_deal_rows_evenly_and_note_nodes(spark, bars, monkeypatch, tmp_path):
    """From a number of rows on every core gets an equal part, and a forest notes the nodes of rows; the trees stay the same."""
    from barloom.ml import training

    table = training_table(bars, ("rsi", "macd")).cache()
    train = table.filter("NOT is_test")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda _: str(tmp_path))
    monkeypatch.setattr(scoring, "DEAL_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    kept = training.kept_rows(train, train.count())
    sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    kept.unpersist()
    assert len(sizes) == cores and max(sizes) - min(sizes) <= 8
    noted, walked = (
        training.fit_classifier(train, "random_forest", 3, columns=("rsi", "macd"), maxDepth=6, **how)
        for how in ({}, {"cacheNodeIds": False})
    )
    assert noted.stages[-1].getOrDefault("cacheNodeIds") and not walked.stages[-1].getOrDefault("cacheNodeIds")
    key = lambda m: sorted(tuple(r) for r in scoring.score(table, m).select("ticker", "date", "prob_up").collect())
    assert key(noted) == key(walked)
    assert scoring.dealt(table, table.count()).rdd.getNumPartitions() == cores
    table.unpersist()


def test_small_fits_keep_their_rows_as_they_are(trained, spark):
    assert not trained.model.stages[-1].getOrDefault("cacheNodeIds")


def test_compared_models_score_every_row_once(trained, bars):
    """The rows that two readers of a curve need are scored and written before."""
    both = scoring.compare_models(bars, {"one": trained.model, "two": trained.model})
    assert "UDF" not in both._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["compare_models", "evaluation_facts"])
def test_models_of_one_query_are_trained_at_the_same_time(spark, trained, bars, monkeypatch, name):
    both = threading.Barrier(2, timeout=20)

    def wait_for_the_other(spark, sf_dir, model_type="random_forest"):
        both.wait()
        return trained

    monkeypatch.setattr(queries, "_trained", wait_for_the_other)
    monkeypatch.setattr(queries, "index_level_bars", lambda *_: bars)
    rows = queries.QUERIES[name](spark, "nowhere").collect()
    kinds = {r["model"] if name == "compare_models" else r["model_type"] for r in rows}
    assert kinds == ({"forest", "boosting"} if name == "compare_models" else {"random_forest", "gradient_boosting"})
