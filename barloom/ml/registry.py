"""Saved models, their metadata table, and the prediction log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.maths import flag
from barloom.ml.boosting import BoostedModel
from barloom.ml.forest import ForestModel
from barloom.ml.scoring import model_columns
from barloom.ml.training import Trained, feature_importance
from barloom.ml.versions import publish, served
from barloom.operators.reports import title_case

# Quality goals, and the ticker preferred for production.
MIN_ACCURACY = 0.55
TARGET_ACCURACY = 0.70
MIN_SHARPE = 1.0
PREFERRED_TICKER = "AAPL"

PERF_NAMES = (
    "total_return",
    "annualized_return",
    "volatility",
    "sharpe_ratio",
    "max_drawdown",
    "win_rate",
    "profit_factor",
    "total_trades",
    "winning_trades",
)
REGISTRY_SCHEMA = (
    "ticker string, model_type string, accuracy double, train_accuracy double, "
    "train_size bigint, test_size bigint, feature_count int, n_estimators int, "
    "random_state int, training_date timestamp, top_features array<string>, "
    "backtest_metrics map<string,double>, model_uri string"
)


def save_model(model: PipelineModel, uri: str) -> str:
    """Write the pipeline; any file system Spark can write to."""
    if not model_columns(model):
        raise ValueError("a model without feature columns cannot score")
    model.write().overwrite().save(uri)
    return uri


def load_model(uri: str) -> PipelineModel | BoostedModel:
    """Read a model back and check that it can score; of a published place, the model served there."""
    uri = served(SparkSession.active(), uri) or uri
    for kind in (BoostedModel, ForestModel):
        found = kind.load(uri)
        if found is not None:
            return found
    model = PipelineModel.load(uri)
    if len(model.stages) < 3 or not hasattr(model.stages[-1], "featureImportances"):
        raise ValueError(f"{uri} holds no pipeline of assembler, scaler and tree classifier")
    return model


def registry_rows(
    trained: Trained, uri: str | None = None, training_date: datetime | None = None
) -> DataFrame:
    """One registry row per series of a trained model.

    Sizes, accuracies and backtest figures are aggregates of the scored rows;
    the fitted model supplies its own parameters, so a tuned model is recorded
    with the values it really has.
    """
    by = list(trained.by)
    test = F.col("is_test")
    hit = (F.col("target") == F.col("prediction")).cast("double")
    sizes = trained.scored.groupBy(*by).agg(
        F.avg(F.when(test, hit)).alias("accuracy"),
        F.avg(F.when(~test, hit)).alias("train_accuracy"),
        F.count_if(~test).alias("train_size"),
        F.count_if(test).alias("test_size"),
    )
    classifier = trained.model.stages[-1]
    top = [r["feature"] for r in feature_importance(trained.model, 5).collect()]
    when = training_date or datetime.now(timezone.utc)
    figures = trained.holdout_metrics()
    figures = figures.select(
        *by, figures_map([F.col(n) for n in PERF_NAMES]).alias("backtest_metrics")
    )
    return sizes.join(figures, by, "left").select(
        *by,
        F.lit(trained.model_type).alias("model_type"),
        "accuracy",
        "train_accuracy",
        "train_size",
        "test_size",
        F.lit(len(trained.columns)).alias("feature_count"),
        F.lit(classifier.getNumTrees).alias("n_estimators"),
        F.lit(trained.seed).alias("random_state"),
        F.lit(when).alias("training_date"),
        F.array(*[F.lit(t) for t in top]).alias("top_features"),
        "backtest_metrics",
        F.lit(uri).cast("string").alias("model_uri"),
    )


def figures_map(figures: list[Column]) -> Column:
    """Performance figures as one map column."""
    as_struct = F.struct(*figures)
    pairs = [
        x
        for name in PERF_NAMES
        for x in (F.lit(name), as_struct[name].cast("double"))
    ]
    return F.create_map(*pairs)


def append_registry(rows: DataFrame, path: str, run: str, part: str = "all") -> None:
    """Add the rows of a run; doing it again, after a failure, replaces them."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/part={part}")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path).drop("run", "part")


def model_info(registry: DataFrame) -> DataFrame:
    """What is known of each model, with defaults for what is not."""

    def known(name: str, default) -> Column:
        if name not in registry.columns:
            return F.lit(default).alias(name)
        value = F.col(name).cast("string") if name == "training_date" else F.col(name)
        return F.coalesce(value, F.lit(default)).alias(name)

    return registry.select(
        known("ticker", "Unknown"),
        known("accuracy", 0.0),
        known("train_accuracy", 0.0),
        known("training_date", "Unknown"),
        known("train_size", 0),
        known("test_size", 0),
        known("feature_count", 0),
        known("model_type", "Unknown"),
    )


def select_production(
    registry: DataFrame, watchlist: list[str], prefer: str = PREFERRED_TICKER
) -> DataFrame:
    """The model to serve: the preferred ticker, else the first one listed.

    Of several models of that ticker the newest counts.  An ordered limit keeps
    one row per task, so the registry is never gathered in one place.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in watchlist]), F.col("ticker"))
    return (
        registry.withColumn("_place", place)
        .filter(F.col("_place") > 0)
        .orderBy(
            F.desc(F.col("ticker") == prefer),
            "_place",
            F.desc("training_date"),
            "model_type",
        )
        .limit(1)
        .drop("_place")
    )


def registry_compare(registry: DataFrame) -> DataFrame:
    """Models side by side, as the comparison table shows them."""
    return registry.select(
        F.concat_ws("", F.lit("Model ("), F.col("ticker"), F.lit(")")).alias("Model"),
        F.col("ticker").alias("Ticker"),
        title_case(F.coalesce("model_type", F.lit("Unknown"))).alias("Model Type"),
        F.col("accuracy").alias("Accuracy"),
        F.col("train_accuracy").alias("Train Accuracy"),
        F.col("feature_count").alias("Features"),
        F.col("training_date").alias("Training Date"),
    )


def quality_gate(
    registry: DataFrame,
    min_accuracy: float = MIN_ACCURACY,
    target_accuracy: float = TARGET_ACCURACY,
    min_sharpe: float = MIN_SHARPE,
) -> DataFrame:
    """Flags for the declared quality goals, and whether the minimums hold."""
    sharpe = F.element_at("backtest_metrics", "sharpe_ratio")
    accurate = flag(F.col("accuracy") >= F.lit(min_accuracy))
    sharp = flag(sharpe >= F.lit(min_sharpe))
    return registry.select(
        "ticker",
        "model_type",
        "accuracy",
        sharpe.alias("sharpe_ratio"),
        accurate.alias("meets_min_accuracy"),
        flag(F.col("accuracy") >= F.lit(target_accuracy)).alias("meets_target_accuracy"),
        sharp.alias("meets_min_sharpe"),
        (accurate * sharp).alias("passes"),
    )


def prediction_records(
    predictions: DataFrame, model_ticker: Column, model_accuracy: Column, timestamp: Column | None = None
) -> DataFrame:
    """Rows of the prediction log out of ``predict_next_day``."""
    when = F.current_timestamp() if timestamp is None else timestamp
    return predictions.select(
        when.alias("timestamp"),
        "ticker",
        "date",
        "current_price",
        "prediction",
        "probability",
        "prob_up",
        "prob_down",
        model_ticker.alias("model_ticker"),
        model_accuracy.alias("model_accuracy"),
    )


#: What tells predictions apart.
HISTORY_KEY = ("model_ticker", "ticker", "date")


def merge_history(records: DataFrame, path: str) -> None:
    """Add predictions that are not in the log at ``path`` yet, by model, ticker and date.

    Doing it again, after a failure or with more records, adds nothing twice.
    """
    spark = records.sparkSession
    if served(spark, path) is None:
        publish(spark, path, lambda folder: spark.createDataFrame([], records.schema).write.parquet(folder))
    there = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in HISTORY_KEY]
    known = read_history(spark, path).select(*[F.col(k).alias(f"_{k}") for k in HISTORY_KEY])
    new = _first_of_each(records).join(known, there, "left_anti")
    new.write.mode("append").parquet(served(spark, path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path``, a row per key: writers at the same time may both have added one."""
    folder = served(spark, path)
    if folder is None:
        raise ValueError(f"{path} holds no prediction log")
    return _first_of_each(spark.read.parquet(folder))


def _first_of_each(records: DataFrame) -> DataFrame:
    columns = [c for c in records.columns if c not in HISTORY_KEY]
    first = F.min(F.struct(*columns)).alias("_first")  # the earliest timestamp comes first
    return records.groupBy(*HISTORY_KEY).agg(first).select(*HISTORY_KEY, "_first.*").select(*records.columns)


def compact_history(spark: SparkSession, path: str) -> None:
    """Write the log's rows anew, without repeats and into fewer files, and serve that."""
    rows = read_history(spark, path)
    publish(spark, path, lambda folder: rows.hint("rebalance").write.parquet(folder))


def append_history(records: DataFrame, path: str) -> None:
    """Add rows as they are; ``merge_history`` keeps one per prediction."""
    records.write.mode("append").parquet(path)


def export_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").option("header", True).csv(path)


def clear_history(spark: SparkSession, path: str) -> None:
    """Empty the log but keep its columns."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
