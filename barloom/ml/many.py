"""A model for each of many series in one pass.

All series are read, split and labelled together; then every series is one group whose trees a task grows on
binned rows. The number of jobs does not depend on the number of series. What comes of a series is a row: a fit that fails
says why and leaves the others as they are. A series of more than ``series_rows`` rows would make a group too large for a task; there
are at most as many of those as such rows fit into the table, and each is fitted by jobs of its own over distributed rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.functions.indicators import FEATURE_COLS
from barloom.ml.boosting import packed_tree, unpacked_tree
from barloom.ml.growth import bin_edges, boost, forest_tree, sigmoid, to_bins
from barloom.ml.scoring import score
from barloom.ml.training import DEFAULTS, MIN_TRAIN_BARS, N_ESTIMATORS, RANDOM_STATE, fit_classifier, model_type_name, training_table
from barloom.ml.tuning import LENGTH, Growth
from barloom.operators.training_set import TEST_SIZE
from barloom.session import cut_lineage

#: Rows of a series that one task fits.
SERIES_ROWS = 200_000
#: Rows of a series that one task scores.
SCORE_ROWS = 32_768

# One table holds everything that a fit leaves: rows of kind "row", "tree" (the first of them with edges) and "outcome".
RESULT = (
    "ticker string, kind string, date {date}, prob_up double, status string, reason string, "
    "number int, feature binary, split binary, child binary, value binary, gain binary, edges binary, base double"
)
MODEL = ("ticker", "number", "feature", "split", "child", "value", "gain", "edges", "base")


@dataclass
class ManyModels:
    """``scored``: train and test rows with ``prediction`` and ``prob_up``; ``models``: a row per tree; ``outcome``: a row per series."""

    scored: DataFrame
    models: DataFrame
    outcome: DataFrame
    columns: tuple[str, ...]
    model_type: str


def fit_series(x: np.ndarray, y: np.ndarray, growth: Growth, seed: int) -> tuple[np.ndarray, list, float]:
    """Bin edges, trees and base of one series."""
    edges = bin_edges(x)
    bins = to_bins(x, edges)
    if growth.name == "random_forest":
        up = y.mean()
        weight = np.where(y > 0.5, 0.5 / up, 0.5 / (1 - up))
        shape = growth.forest_shape(x.shape[1])
        share = float(growth.params["subsamplingRate"])
        return edges, [forest_tree(bins, y, weight, shape, share, seed, k) for k in range(growth.most)], 0.0
    settings = growth.settings(seed, x.shape[1])
    if not settings.second_order:
        settings.base = float(np.log(y.mean() / (1 - y.mean())))
    return edges, boost(bins, y, np.arange(len(y)), settings)[0], settings.base


def probability(x: np.ndarray, edges: np.ndarray, trees: list, base: float, forest: bool) -> np.ndarray:
    bins = to_bins(x, edges)
    total = np.full(len(x), base)
    for tree in trees:
        total += tree.value[tree.route(bins)]
    return np.clip(total / len(trees), 0.0, 1.0) if forest else sigmoid(total)


def train_many(
    bars: DataFrame,
    model_type: str = "random_forest",
    n_estimators: int = N_ESTIMATORS,
    seed: int = RANDOM_STATE,
    test_size: float = TEST_SIZE,
    columns=tuple(FEATURE_COLS),
    series_rows: int = SERIES_ROWS,
    **overrides,
) -> ManyModels:
    """One model per ticker of ``bars``, scored on its train and test rows.

    Series with too few bars or one class only are ``not trained``, errors of a fit ``failed``; both have their reason.
    """
    name, columns, spark = model_type_name(model_type), tuple(columns), bars.sparkSession
    table = cut_lineage(training_table(bars, columns, test_size=test_size))
    date = table.schema["date"].dataType.simpleString()
    growth = Growth(name, {**DEFAULTS[name], **overrides}, {0: {**DEFAULTS[name], **overrides, LENGTH[name]: n_estimators}})
    forest = name == "random_forest"

    def fit(rows: pa.Table) -> pa.Table:
        ticker = rows["ticker"][0].as_py()
        rows = rows.sort_by("date")
        blank = dict.fromkeys(("date", "prob_up", "status", "reason", "number", "feature", "split", "child", "value", "gain", "edges", "base"))

        def outcome(status: str, reason: str) -> list[dict]:
            return [{"ticker": ticker, "kind": "outcome", **blank, "status": status, "reason": reason}]

        out = []
        try:
            x = np.stack([rows[c].to_numpy() for c in columns], axis=1).astype(float)
            train = ~rows["is_test"].to_numpy()
            y = rows["target"].to_numpy()[train].astype(float)
            if not 0 < y.mean() < 1:
                out = outcome("not trained", "the training rows have one class only")
            else:
                edges, trees, base = fit_series(x[train], y, growth, seed)
                chance = probability(x, edges, trees, base, forest)
                out = outcome("trained", "")
                out += [{"ticker": ticker, "kind": "row", **blank, "date": d, "prob_up": p} for d, p in zip(rows["date"].to_pylist(), chance.tolist())]
                fields = ("number", "feature", "split", "child", "value", "gain")
                for k, tree in enumerate(trees):
                    out.append({"ticker": ticker, "kind": "tree", **blank, **dict(zip(fields, packed_tree(k, tree))), "edges": edges.tobytes() if k == 0 else None, "base": base})
        except Exception as error:  # of this series' rows; losing an executor is no Python error
            out = outcome("failed", f"{type(error).__name__}: {error}")
        kinds = [pa.string(), pa.string(), rows.schema.field("date").type, pa.float64(), pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 6, pa.float64()]
        names = ["ticker", "kind", *blank]
        return pa.table({n: pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)})

    small = table.filter(F.col("n_bars") <= series_rows)
    found = cut_lineage(small.select("ticker", "date", "is_test", "target", *columns).groupBy("ticker").applyInArrow(fit, RESULT.format(date=date)))
    chances = found.filter("kind = 'row'").select("ticker", "date", "prob_up")
    scored = small.join(chances, ["ticker", "date"])
    scored = scored.withColumn("prediction", (F.col("prob_up") > 0.5).cast("int")).select(*table.columns, "prediction", "prob_up")
    outcome = found.filter("kind = 'outcome'").select("ticker", "status", "reason")
    models = found.filter("kind = 'tree'").select(*MODEL)
    for r in table.filter(F.col("n_bars") > series_rows).select("ticker").distinct().collect():
        rows = table.filter(F.col("ticker") == r["ticker"])
        classes = rows.filter("NOT is_test").select("target").distinct().count()
        if classes < 2:
            now = (r["ticker"], "not trained", "the training rows have one class only")
        else:
            model = fit_classifier(rows.filter("NOT is_test"), name, n_estimators, seed, columns, **overrides)
            scored = scored.unionByName(cut_lineage(score(rows, model)).select(scored.columns))
            now = (r["ticker"], "trained", "by itself")
        outcome = outcome.unionByName(spark.createDataFrame([now], "ticker string, status string, reason string"))
    missing = bars.select("ticker").distinct().join(outcome.select("ticker"), "ticker", "left_anti")
    few = missing.select("ticker", F.lit("not trained").alias("status"), F.lit(f"fewer than {MIN_TRAIN_BARS} bars").alias("reason"))
    return ManyModels(scored, models, outcome.unionByName(few), columns, name)


def score_many(features: DataFrame, models: DataFrame, columns, model_type: str = "random_forest") -> DataFrame:
    """``features`` (with ``idx``) with ``prediction`` and ``prob_up`` by the model of their own series.

    Rows meet their model in chunks of a series, so no group holds a whole long series. Series without a
    model are left out.
    """
    forest = model_type_name(model_type) == "random_forest"
    rows = features.withColumn("_part", F.expr(f"idx div {SCORE_ROWS}"))
    parts = rows.select(F.col("ticker").alias("_of"), F.col("_part").alias("_at")).distinct()
    parts = parts.join(models, F.col("_of") == F.col("ticker"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema) + ", prob_up double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["_part"])
        if not right.num_rows:
            left = left.slice(0, 0)
        if not left.num_rows:
            return left.append_column("prob_up", pa.array([], pa.float64()))
        found = sorted(right.select(list(MODEL)).to_pylist(), key=lambda r: r["number"])
        edges = np.frombuffer(found[0]["edges"]).reshape(len(columns), -1)
        trees = [unpacked_tree([r[c] for c in MODEL[1:7]]) for r in found]
        x = np.stack([left[c].to_numpy() for c in columns], axis=1).astype(float)
        return left.append_column("prob_up", pa.array(probability(x, edges, trees, found[0]["base"], forest)))

    scored = rows.groupBy("ticker", "_part").cogroup(parts.groupBy("_of", "_at")).applyInArrow(run, schema)
    return scored.withColumn("prediction", (F.col("prob_up") > 0.5).cast("int"))
