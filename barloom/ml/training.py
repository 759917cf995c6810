"""Fit tree ensembles on the feature table with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.indicators import FEATURE_COLS
from barloom.ml.boosting import BoostedModel, SecondOrder
from barloom.ml.forest import fit_forest, is_grown_here
from barloom.ml.plain_boosting import fit_boosting, is_boosted_here
from barloom.ml.scoring import dealt, is_large, score
from barloom.operators.backtest import backtest_signals, perf_metrics
from barloom.operators.features import compute_features
from barloom.operators.metrics import class_metrics, classification_report
from barloom.operators.training_set import TEST_SIZE, test_start, time_split, with_class_weight
from barloom.session import cut_lineage

# Model types, their defaults, and the rows a series must have.
MODEL_TYPES = ("random_forest", "xgboost", "gradient_boosting")
MIN_TRAIN_BARS = 50
#: Training rows from which a forest is grown by ``ml.forest``, and plain boosting by ``ml.plain_boosting``.
FOREST_ROWS = 5_000
N_ESTIMATORS = 200
RANDOM_STATE = 42
DEFAULTS = {
    "random_forest": {
        "maxDepth": 15,
        "minInstancesPerNode": 2,
        "featureSubsetStrategy": "sqrt",
    },
    "gradient_boosting": {
        "maxDepth": 5,
        "stepSize": 0.05,
        "subsamplingRate": 0.9,
        "minInstancesPerNode": 2,
        "featureSubsetStrategy": "sqrt",
    },
    # Second-order boosting; the least of a node is a sum of hessians, features are drawn per tree.
    "xgboost": {
        "maxDepth": 5,
        "stepSize": 0.05,
        "subsamplingRate": 0.9,
        "minInstancesPerNode": 3,
        "featureSubsetStrategy": "0.9",
    },
}


def model_type_name(model_type: str) -> str:
    name = model_type.lower().strip()
    if name not in MODEL_TYPES:
        raise ValueError(f"no model type {name!r}; there are {', '.join(MODEL_TYPES)}")
    return name


def make_classifier(
    model_type: str, n_estimators: int = N_ESTIMATORS, seed: int = RANDOM_STATE, **overrides
):
    name = model_type_name(model_type)
    params = {**DEFAULTS[name], **overrides}
    shared = {"featuresCol": "scaled", "labelCol": "target", "seed": seed, **params}
    if name == "random_forest":
        # Balanced class weights, as a column of the training table.
        return RandomForestClassifier(numTrees=n_estimators, weightCol="class_weight", **shared)
    if name == "xgboost":
        return SecondOrder(seed, n_estimators, **params)
    return GBTClassifier(maxIter=n_estimators, **shared)


def feature_stages(columns=tuple(FEATURE_COLS)) -> list:
    return [
        VectorAssembler(inputCols=list(columns), outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
    ]


def kept_rows(rows: DataFrame, n_rows: int = 0) -> DataFrame:
    """Training rows in evenly sized partitions, cached for many passes.

    Trees read their rows once per level, so one more exchange pays off when
    it leaves neither tiny nor oversized partitions.  More parts than cores send
    the histograms of all nodes more often than needed.  Cached blocks of a lost
    executor are computed again from the lineage.
    """
    rows = dealt(rows, n_rows) if is_large(n_rows) else rows.hint("rebalance")
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def note_nodes(estimator, spark: SparkSession) -> None:
    """Lets a forest note the node of every row instead of walking each tree from its root on every level.

    The notes grow a lineage that only checkpoints cut, so without a checkpoint folder it is left as it is.
    """
    if isinstance(estimator, RandomForestClassifier) and not estimator.isSet("cacheNodeIds"):
        estimator.setCacheNodeIds(spark.sparkContext.getCheckpointDir() is not None)


def fit_classifier(
    train: DataFrame,
    model_type: str = "random_forest",
    n_estimators: int = N_ESTIMATORS,
    seed: int = RANDOM_STATE,
    columns=tuple(FEATURE_COLS),
    **overrides,
) -> PipelineModel | BoostedModel:
    """Assemble, scale and fit on rows kept in memory or on disk; second-order boosting and large fits bin rows instead."""
    estimator = make_classifier(model_type, n_estimators, seed, **overrides)
    rows = train.select(*columns, "target")
    if isinstance(estimator, SecondOrder):
        return estimator.fit(rows, columns)
    n_rows = rows.count()
    if n_rows >= FOREST_ROWS and is_grown_here(estimator, columns):
        return fit_forest(rows, columns, estimator, n_rows)
    if n_rows >= FOREST_ROWS and is_boosted_here(estimator):
        return fit_boosting(rows, columns, estimator, n_rows)
    if is_large(n_rows):
        note_nodes(estimator, train.sparkSession)
    if estimator.hasParam("weightCol") and estimator.isSet("weightCol"):
        rows = with_class_weight(rows)
    rows = kept_rows(rows, n_rows)
    try:
        return Pipeline(stages=[*feature_stages(columns), estimator]).fit(rows)
    finally:
        rows.unpersist()


@dataclass
class Trained:
    """A fitted model with the scored rows of its split.

    ``scored`` is a written table, so evaluation, report and hold-out do not
    compute features again.  ``trials`` holds the search of a tuned model.
    """

    model: PipelineModel | BoostedModel
    model_type: str
    seed: int
    scored: DataFrame
    columns: tuple[str, ...]
    by: tuple[str, ...] = ("ticker",)
    test_size: float = TEST_SIZE
    trials: DataFrame | None = None

    def evaluation(self, by: tuple[str, ...] | None = None) -> DataFrame:
        """Accuracy and the other class metrics of train and test rows."""
        by = self.by if by is None else by
        return class_metrics(self.scored, (*by, "is_test"), score="prob_up")

    def report(self) -> DataFrame:
        return classification_report(self.scored.filter("is_test"), self.by)

    def holdout_curve(self, min_rows: int = 26) -> DataFrame:
        """Backtest of the test rows; series with too few of them are left out.

        Test rows are the last of their series, so their positions follow from
        those they have.
        """
        first = test_start(self.test_size)
        signals = self.scored.filter("is_test").select(
            *self.by,
            "date",
            F.col("prediction").alias("position"),
            F.col("Close").alias("price"),
            (F.col("idx") - first).alias("idx"),
            (F.col("n_bars") - first).alias("n_bars"),
        )
        return backtest_signals(signals.filter(F.col("n_bars") >= min_rows), self.by)

    def holdout_metrics(self) -> DataFrame:
        return perf_metrics(self.holdout_curve(), self.by)


def training_table(
    bars: DataFrame,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    test_size: float = TEST_SIZE,
    min_bars: int = MIN_TRAIN_BARS,
    drop_unlabeled: bool = False,
) -> DataFrame:
    """Feature rows with ``is_test``; the split is by time inside each series.

    The row gate counts raw bars, before rows without Close or Volume go.
    """
    features = compute_features(
        bars, columns, by, drop_unlabeled=drop_unlabeled, min_raw=min_bars
    )
    return time_split(features, test_size)


def train_model(
    bars: DataFrame,
    model_type: str = "random_forest",
    n_estimators: int = N_ESTIMATORS,
    seed: int = RANDOM_STATE,
    test_size: float = TEST_SIZE,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    tune: bool = False,
    search: dict | None = None,
    **overrides,
) -> Trained:
    """One pooled model over all series, scored on train and test rows.

    ``tune`` searches tree parameters first and keeps the best model, refitted
    on all training rows; ``search`` holds options of ``tune_classifier``.
    """
    name = model_type_name(model_type)
    table = cut_lineage(training_table(bars, columns, by, test_size))
    train, trials = table.filter(~F.col("is_test")), None
    if tune:
        from barloom.ml.tuning import tune_classifier  # builds on this module

        options = {"seed": seed, "columns": columns, "by": by, **(search or {})}
        model, trials = tune_classifier(train, name, **options)
    else:
        model = fit_classifier(train, name, n_estimators, seed, columns, **overrides)
    scored = cut_lineage(score(dealt(table, table.count()), model))
    return Trained(model, name, seed, scored, tuple(columns), tuple(by), test_size, trials)


@dataclass
class TickerModels:
    """Models by ticker, and what became of every ticker asked for."""

    models: dict[str, Trained] = field(default_factory=dict)
    outcome: DataFrame | None = None


def trainable(bars: DataFrame, min_bars: int = MIN_TRAIN_BARS) -> DataFrame:
    """``ticker, n_bars, n_up, n_down`` of the series that a model can be fitted to."""
    rows = training_table(bars, (), min_bars=min_bars).filter(~F.col("is_test"))
    return rows.groupBy("ticker").agg(
        F.max("n_bars").alias("n_bars"),
        F.count_if(F.col("target") == 1).alias("n_up"),
        F.count_if(F.col("target") == 0).alias("n_down"),
    )


def train_by_ticker(
    bars: DataFrame,
    tickers: list[str],
    parallelism: int = 4,
    keep: Callable[[str, Trained], object] | None = None,
    **options,
) -> TickerModels:
    """One model per listed ticker, each fit distributed, ``parallelism`` of them at a time.

    ``outcome`` has a row for every ticker with ``status`` and ``reason``.  What
    keeps a series from being learned is found in one pass beforehand; an error
    during a fit is no property of the series and is raised when the other fits
    have ended.  ``keep`` gets every model as its fit ends, so none of them is
    lost.  For a short list: ``many.train_many`` fits thousands in one pass.
    """
    spark = bars.sparkSession
    listed = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    found = {r["ticker"]: r for r in trainable(bars).join(listed, "ticker", "left_semi").collect()}
    result, rows, able = TickerModels(), [], []
    for ticker in dict.fromkeys(tickers):
        facts = found.get(ticker)
        if facts is None:
            rows.append((ticker, "not trained", f"fewer than {MIN_TRAIN_BARS} bars"))
        elif not (facts["n_up"] and facts["n_down"]):
            rows.append((ticker, "not trained", "the training rows have one class only"))
        else:
            able.append(ticker)
            rows.append((ticker, "trained", ""))

    @inheritable_thread_target(spark)
    def fit(ticker: str) -> Trained | Exception:
        try:
            trained = train_model(bars.filter(F.col("ticker") == ticker), **options)
            if keep is not None:
                keep(ticker, trained)
            return trained
        except Exception as error:  # raised below
            return error

    with ThreadPool(parallelism) as pool:
        result.models = dict(zip(able, pool.map(fit, able, chunksize=1)))
    for trained in result.models.values():
        if isinstance(trained, Exception):
            raise trained
    result.outcome = spark.createDataFrame(rows, "ticker string, status string, reason string")
    return result


def feature_importance(model: PipelineModel, top: int | None = 10) -> DataFrame:
    """Importance of each feature column, largest first."""
    spark = SparkSession.active()
    weights = model.stages[-1].featureImportances.toArray()
    names = model.stages[0].getInputCols()
    rows = [(n, float(w)) for n, w in zip(names, weights)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    table = table.orderBy(F.desc("importance"), "feature")
    return table if top is None else table.limit(top)
