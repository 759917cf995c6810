"""Apply a fitted pipeline to feature rows."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from barloom.operators.backtest import backtest_signals, perf_metrics
from barloom.operators.cleaning import date_range, require_columns
from barloom.operators.evaluation import compare_curves
from barloom.operators.features import compute_features, fill_features, latest_features
from barloom.operators.metrics import class_metrics
from barloom.operators.walkforward import evaluate_windows, window_features
from barloom.session import cut_lineage

#: Rows from which a table is dealt by their number for trees, and the most of them in a part.
DEAL_ROWS = 20_000
PART_ROWS = 250_000


def is_large(n_rows: int) -> bool:
    return n_rows >= DEAL_ROWS


def dealt(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows of a table of at least ``DEAL_ROWS`` in equal parts, one for every core; smaller ones as they are.

    What trees cost goes by rows and not by bytes, so parts sized by bytes or by chunks of a series leave cores idle.
    """
    if not is_large(n_rows):
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, math.ceil(n_rows / PART_ROWS)))


def model_columns(model: PipelineModel) -> list[str]:
    """The feature columns a saved model expects, in order."""
    return list(model.stages[0].getInputCols())


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` (0/1) and ``prob_up``; nothing is shuffled."""
    require_columns(features, model_columns(model))
    scored = model.transform(features)
    return scored.select(
        *features.columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("prob_up"),
    )


def predict_next_day(bars: DataFrame, model: PipelineModel, by=("ticker",)) -> DataFrame:
    """Direction for the bar after the last one, one row per series."""
    rows = latest_features(bars, 1, model_columns(model), by)
    return label_predictions(score(rows, model), by)


def label_predictions(scored: DataFrame, by=("ticker",)) -> DataFrame:
    """``Up``/``Down`` with the probability of the predicted class."""
    up = F.col("prediction") == 1
    down_prob = F.lit(1.0) - F.col("prob_up")
    return scored.select(
        *by,
        "date",
        F.col("Close").alias("current_price"),
        F.when(up, "Up").otherwise("Down").alias("prediction"),
        F.when(up, F.col("prob_up")).otherwise(down_prob).alias("probability"),
        "prob_up",
        down_prob.alias("prob_down"),
    )


def model_signals(bars: DataFrame, model: PipelineModel, start=None, end=None, by=("ticker",)):
    """Scored rows of a date range with ``position`` and ``price``."""
    features = compute_features(date_range(bars, start, end), model_columns(model), by)
    return score(features, model).withColumns(
        {"position": F.col("prediction"), "price": F.col("Close")}
    )


def backtest_model(
    bars: DataFrame, model: PipelineModel, start=None, end=None, by=("ticker",), **options
) -> dict[str, DataFrame]:
    """Daily curve, performance and classification of a model, as tables.

    The scored rows are written once; all three tables read them.
    """
    signals = cut_lineage(model_signals(bars, model, start, end, by))
    curve = backtest_signals(signals, by, **options)
    return {
        "daily": curve,
        "performance": perf_metrics(curve, by),
        "classification": class_metrics(signals, by, score="prob_up"),
    }


def compare_models(
    bars: DataFrame, models: dict[str, PipelineModel], by=("ticker",), **options
) -> DataFrame:
    """Models side by side on the same bars, one row per series and model.

    One pass over the features: each model adds its columns, then every bar is
    repeated per model.  Features and scored rows are written once, so that rows
    are dealt evenly and the two readers of a curve do not score them twice.
    """
    if not models:
        raise ValueError("no model to compare")
    columns = tuple(dict.fromkeys(c for m in models.values() for c in model_columns(m)))
    table = cut_lineage(compute_features(bars, columns, by))
    rows = dealt(table, table.count())
    entries = []
    for i, (name, model) in enumerate(models.items()):
        own = {"prediction": f"_prediction_{i}", "prob_up": f"_prob_up_{i}"}
        rows = score(rows, model).withColumnsRenamed(own)
        entries.append(
            F.struct(
                F.lit(name).alias("model"), *[F.col(mine).alias(n) for n, mine in own.items()]
            )
        )
    keep = [*by, "date", F.col("Close").alias("price"), "target", "idx", "n_bars"]
    scored = cut_lineage(rows.select(*keep, F.inline(F.array(*entries))))
    signals = scored.withColumn("position", F.col("prediction"))
    keys = (*by, "model")
    return compare_curves(backtest_signals(signals, keys, **options), keys, "prediction")


def walk_forward_model(
    bars: DataFrame, model: PipelineModel, by=("ticker",), train=252, test=63, step=21, **options
) -> DataFrame:
    """A given model on every walk-forward test window; it is not refitted."""
    columns = model_columns(model)
    panel = window_features(bars, columns, by, train=train, test=test, step=step)
    scored = score(fill_features(panel.df, columns), model)
    panel = panel.with_df(
        scored.withColumns({"position": F.col("prediction"), "price": F.col("Close")})
    )
    return evaluate_windows(panel, **options)
