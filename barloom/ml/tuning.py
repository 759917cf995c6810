"""Random search over tree parameters, cross-validated, with a trial table that a restart continues.

Points of the search that differ only in the number of trees or rounds, or in the depth of a forest, are
judged by one growth: tree ``k`` of a forest depends on its number alone, a deeper tree begins with the levels of
a shallower one, and boosting passes through fewer rounds on its way to more. Every row is judged, whatever the size of the table.
Up to ``BLOCK_ROWS`` rows, growth runs in tasks of a hundred trees, or of one fold of boosting, over a block of all rows; trees
live as long as their task, and only the summed votes for the held-out rows leave it. Over larger tables trees are grown
node by node, or level by level, over distributed rows (``ml.forest``, ``ml.boosting``): the same trees, as rows are drawn by a hash
of their keys and bins are exact; in boosting rounding may turn ties between splits. The trials of a growth are written when it ends.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.indicators import FEATURE_COLS
from barloom.ml import forest
from barloom.ml.boosting import SecondOrder, _boost_together, _rows_of, exact_edges, pack_rows
from barloom.ml.growth import Boosting, Shape, Tree, boost, drawn_features
from barloom.ml.scoring import dealt
from barloom.ml.training import RANDOM_STATE, fit_classifier, model_type_name
from barloom.operators.training_set import with_folds
from barloom.session import cut_lineage, shared_folder

# Search spaces and search effort.
SEARCH_SPACES = {
    "random_forest": {
        "numTrees": [300, 500, 700],
        "maxDepth": [8, 10, 12, 15],
        "minInstancesPerNode": [2, 4, 6],
        "featureSubsetStrategy": ["sqrt", "log2"],
        "subsamplingRate": [0.7, 0.8, 0.9],
    },
    "xgboost": {
        "maxIter": [200, 300, 500],
        "maxDepth": [3, 5, 7, 10],
        "stepSize": [0.01, 0.05, 0.1],
        "subsamplingRate": [0.8, 0.9, 1.0],
        "featureSubsetStrategy": ["0.8", "0.9", "1.0"],
        "minInstancesPerNode": [1, 3, 5],
        "minInfoGain": [0.0, 0.1, 0.2],
    },
    "gradient_boosting": {
        "maxIter": [200, 300, 500],
        "maxDepth": [3, 5, 7, 10],
        "stepSize": [0.01, 0.05, 0.1],
        "subsamplingRate": [0.8, 0.9, 1.0],
        "minInstancesPerNode": [1, 2, 4],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
    },
}
SEARCH_DRAWS = 30
SEARCH_FOLDS = 3


def draw_params(space: dict[str, list], draws: int, seed: int) -> list[dict]:
    """Distinct random points of a grid; the whole grid if it is small."""
    names = list(space)
    grid = [dict(zip(names, point)) for point in itertools.product(*space.values())]
    if draws >= len(grid):
        return grid
    return random.Random(seed).sample(grid, draws)
#: Rows up to which a task grows trees over all of them.
BLOCK_ROWS = 100_000
#: Trees that one task grows.
TREES_PER_TASK = 100

TRIAL_SCHEMA = "trial int, fold int, correct long, n long"
# What the other parameters are where a space does not name them.
UNNAMED = {"maxDepth": 5, "minInstancesPerNode": 1, "featureSubsetStrategy": "all", "subsamplingRate": 1.0, "stepSize": 0.1, "minInfoGain": 0.0}
LENGTH = {"random_forest": "numTrees", "xgboost": "maxIter", "gradient_boosting": "maxIter"}


class Growth:
    """Trials that one growth judges: the same parameters but for length and, in forests, depth."""

    def __init__(self, name: str, params: dict, trials: dict[int, dict]):
        self.name, self.params, self.trials = name, {**UNNAMED, **params}, trials
        self.lengths = {t: int(p[LENGTH[name]]) for t, p in trials.items()}
        self.depths = {t: int(p.get("maxDepth", UNNAMED["maxDepth"])) for t, p in trials.items()}
        self.most = max(self.lengths.values())

    def units(self, folds: int) -> list[tuple[int, int, int]]:
        """``fold, first, last``: trees of forests in parts that end wherever a trial does, boosting in one part."""
        if self.name != "random_forest":
            return [(fold, 0, self.most) for fold in range(folds)]
        stops = sorted({*range(0, self.most, TREES_PER_TASK), *self.lengths.values()})
        return [(fold, a, b) for fold in range(folds) for a, b in zip(stops, stops[1:])]

    def forest_shape(self, columns: int) -> Shape:
        return Shape(max(self.depths.values()), int(self.params["minInstancesPerNode"]), per_node=drawn_features(self.params["featureSubsetStrategy"], columns))

    def settings(self, seed: int, columns: int, up: float = 0.0) -> Boosting:
        """Settings of boosting; plain boosting begins with the share ``up`` of the rows that are fitted."""
        p = self.params
        if self.name == "xgboost":
            return SecondOrder(seed, **{**p, "maxIter": self.most}).settings
        shape = Shape(int(p["maxDepth"]), int(p["minInstancesPerNode"]), per_node=drawn_features(p["featureSubsetStrategy"], columns))
        base = float(np.log(up / (1 - up))) if 0 < up < 1 else 0.0
        return Boosting(self.most, float(p["stepSize"]), shape, float(p["subsamplingRate"]), 1.0, False, seed, base)

    def votes(self, key: np.ndarray, y: np.ndarray, bins: np.ndarray, weights: tuple[float, float], held: np.ndarray, first: int, last: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """``depth, upto, sums``: votes (or margins) of trees ``first`` to ``last`` for the held-out rows."""
        fit = ~held
        if self.name == "random_forest":
            depths = sorted(set(self.depths.values()))
            shape = self.forest_shape(bins.shape[1])
            sums = {d: np.zeros(int(held.sum())) for d in depths}
            keys, labels, train, test = key[fit], y[fit], bins[fit], bins[held]
            for number in range(first, last):
                tree = forest.block_tree(keys, labels, train, number, shape, seed, float(self.params["subsamplingRate"]), weights)
                for d, node in zip(depths, tree.route(test, depths)):
                    sums[d] += tree.value[node] - 0.5
            for d in depths:
                yield d, last, sums[d]
        else:
            settings = self.settings(seed, bins.shape[1], y[fit].mean())
            stops = tuple(sorted(set(self.lengths.values())))
            _, seen = boost(bins[fit], y[fit], key[fit], settings, bins[held], stops)
            for upto, margin in seen.items():
                yield 0, upto, margin

    def judged(self, table: pa.Table, y: np.ndarray) -> list[tuple[int, int]]:
        """``trial, correct`` of one fold, from all its votes."""
        rows = table.to_pylist()
        out = []
        for trial, length in self.lengths.items():
            if self.name == "random_forest":
                parts = [r["sums"] for r in rows if r["upto"] <= length and r["depth"] == self.depths[trial]]
            else:
                parts = [r["sums"] for r in rows if r["upto"] == length]
            votes = sum(np.frombuffer(p) for p in parts)
            out.append((trial, int(((votes > 0) == (y > 0.5)).sum())))
        return out


def growths(name: str, trials: list[dict]) -> list[Growth]:
    """The trials, put together where one growth judges several."""
    apart = {LENGTH[name]} | ({"maxDepth"} if name == "random_forest" else set())
    groups: dict[str, dict[int, dict]] = {}
    for i, trial in enumerate(trials):
        key = json.dumps({k: v for k, v in trial.items() if k not in apart}, sort_keys=True)
        groups.setdefault(key, {})[i] = trial
    return [Growth(name, json.loads(key), some) for key, some in groups.items()]


def _run(spark: SparkSession, growth: Growth, data: Broadcast | DataFrame, folds: int, seed: int, weights: tuple[float, float], columns: int) -> DataFrame:
    """``trial, fold, correct, n`` of one growth; ``data`` is a broadcast of keys, labels, bins and folds, or packed rows of a large table."""
    if isinstance(data, DataFrame):
        found = [r for fold in range(folds) for r in _judged_together(growth, data, fold, seed, weights, columns)]
        return spark.createDataFrame(found, TRIAL_SCHEMA).coalesce(1)
    units = growth.units(folds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                key, y, bins, fold_of = data.value
                fold, first, last = units[unit]
                found = list(growth.votes(key, y, bins, weights, fold_of == fold, first, last, seed))
                names = ["fold", "depth", "upto", "sums"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fold] * len(found), pa.int32()),
                        pa.array([d for d, _, _ in found], pa.int32()),
                        pa.array([u for _, u, _ in found], pa.int32()),
                        pa.array([s.tobytes() for _, _, s in found], pa.binary()),
                    ],
                    names=names,
                )

    def judge(table: pa.Table) -> pa.Table:
        _, y, _, fold_of = data.value
        fold = table["fold"][0].as_py()
        mine = y[fold_of == fold]
        done = growth.judged(table, mine)
        return pa.table(
            {
                "trial": pa.array([t for t, _ in done], pa.int32()),
                "fold": pa.array([fold] * len(done), pa.int32()),
                "correct": pa.array([c for _, c in done], pa.int64()),
                "n": pa.array([len(mine)] * len(done), pa.int64()),
            }
        )

    votes = spark.range(0, len(units), 1, len(units)).mapInArrow(work, "fold int, depth int, upto int, sums binary")
    return votes.groupBy("fold").applyInArrow(judge, TRIAL_SCHEMA)


def _judged_together(growth: Growth, packed: DataFrame, fold: int, seed: int, weights: tuple[float, float], columns: int) -> list[tuple]:
    """What ``judged`` says of one fold, by trees over distributed rows; ``packed`` has labels with folds (see ``search``)."""
    of, label = F.floor(F.col("y") / 2), F.col("y") - 2 * F.floor(F.col("y") / 2)
    fit, held = packed.filter(of != fold).withColumn("y", label), packed.filter(of == fold).withColumn("y", label)
    n, up = fit.agg(F.count(F.lit(1)), F.avg("y")).first()
    correct: dict[tuple[int, int], int] = {}
    if growth.name == "random_forest":
        shape, depths = growth.forest_shape(columns), sorted(set(growth.depths.values()))
        held = held.withColumn("votes", F.lit(bytes(8 * len(depths))))
        stops = sorted({*range(0, growth.most, max(1, forest.BATCH_ROWS // max(1, n))), *growth.lengths.values()})
        for first, last in zip(stops, stops[1:]):
            trees = forest.grown_trees(fit, n, first, last, shape, seed, float(growth.params["subsamplingRate"]), weights, columns)
            held = cut_lineage(_with_votes(held, trees, depths))
            if last in growth.lengths.values():
                for at, found in enumerate(_correct(held, len(depths))):
                    correct[last, depths[at]] = found
    else:
        settings = growth.settings(seed, columns, up)
        trees = _boost_together(fit.withColumn("margin", F.lit(settings.base)), settings, columns)
        held = held.withColumn("votes", F.lit(np.float64(settings.base).tobytes()))
        stops = sorted({0, *growth.lengths.values()})
        for first, last in zip(stops, stops[1:]):
            held = cut_lineage(_with_votes(held, trees[first:last]))
            correct[last, 0] = _correct(held, 1)[0]
    rows = held.count()
    return [(t, fold, correct[length, growth.depths[t] if growth.name == "random_forest" else 0], rows) for t, length in growth.lengths.items()]


def _with_votes(held: DataFrame, trees: list[Tree], depths: list[int] | None = None) -> DataFrame:
    """``held`` with the votes of forest trees cut at each of ``depths``, or the margins of boosted ones, added up."""
    shared = held.sparkSession.sparkContext.broadcast(trees)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            _, y, _, bins = _rows_of(batch)
            votes = np.frombuffer(b"".join(batch.column(4).to_pylist())).reshape(len(y), -1).copy()
            for tree in shared.value:
                if depths is None:
                    votes[:, 0] += tree.value[tree.route(bins)]
                else:
                    for at, node in enumerate(tree.route(bins, depths)):
                        votes[:, at] += tree.value[node] - 0.5
            yield batch.set_column(4, "votes", pa.array([v.tobytes() for v in votes], pa.binary()))

    return held.mapInArrow(add, held.schema)


def _correct(held: DataFrame, width: int) -> list[int]:
    """Rows whose label each of their votes agrees with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            votes = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, width)
            up = batch.column(0).to_numpy() > 0.5
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(((votes > 0) == up[:, None]).sum(axis=0))], names=["at", "correct"])

    rows = held.select("y", "votes").mapInArrow(run, "at long, correct long").groupBy("at").agg(F.sum("correct").alias("correct"))
    found = {r["at"]: r["correct"] for r in rows.collect()}
    return [found.get(at, 0) for at in range(width)]


def _written(spark: SparkSession, path: str) -> list[tuple] | None:
    """Trials of a growth that an earlier run has written to the end."""
    try:
        return [tuple(r) for r in spark.read.schema(TRIAL_SCHEMA).parquet(path).collect()]
    except AnalysisException:
        return None


def search_rows(train: DataFrame, folds: int, columns, by, max_rows: int | None = None) -> DataFrame:
    """Rows of the search with their ``fold``, written once: all, or a sample of about ``max_rows`` by hash if a caller asks for one."""
    rows = cut_lineage(with_folds(train, folds, by).select(*by, "date", *columns, "target", "fold"))
    if max_rows is None:
        return rows
    share = max_rows / max(1, rows.count())
    if share >= 1:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*by, "date"), F.lit(1 << 20)) < int(share * (1 << 20)))


def _block(packed: DataFrame) -> tuple[np.ndarray, ...]:
    """Keys, labels, bins and folds of all rows of a small table."""
    parts = [_rows_of(b) for b in packed.toArrow().sort_by("key").to_batches() if b.num_rows]
    key, coded, _, bins = (np.concatenate(x) for x in zip(*parts))
    return key, coded % 2, bins, (coded // 2).astype(int)


def search(
    train: DataFrame,
    model_type: str = "random_forest",
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    seed: int = RANDOM_STATE,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    space: dict[str, list] | None = None,
    path: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """The trial table: ``trial, params, accuracy`` (mean over folds), ``best`` (the first of the highest) and ``n_rows`` judged.

    Every row of ``train`` is judged; only a caller that names ``max_rows`` gets a search on a sample.
    ``path`` keeps what each growth found under a name made of the trials and the rows; a second call
    with the same ones runs only the growths that are not there yet. Weights and bins come from all rows of
    the search; a fold's own would differ slightly.
    """
    spark, name = train.sparkSession, model_type_name(model_type)
    trials = draw_params(space or SEARCH_SPACES[name], draws, seed)
    rows = search_rows(train, folds, columns, by, max_rows)
    n, mark = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    mark = hashlib.sha256(json.dumps([name, trials, folds, seed, list(columns), n, str(mark)]).encode()).hexdigest()[:16]
    folder = f"{(path or f'{shared_folder(spark)}/barloom-searches/{uuid.uuid4().hex}').rstrip('/')}/search={mark}"
    # Rows are drawn by a hash of what they are the only ones to have; labels travel with the folds.
    coded = rows.withColumns({"_key": F.xxhash64(*by, "date"), "_coded": F.col("target") + 2 * F.col("fold")})
    packed = pack_rows(dealt(coded, n), columns, exact_edges(rows, columns, n), "_coded", "_key")
    up = packed.agg(F.avg(F.col("y") - 2 * F.floor(F.col("y") / 2))).first()[0]
    weights = (0.5 / max(1 - up, 1e-12), 0.5 / max(up, 1e-12))
    data = packed if n > BLOCK_ROWS else spark.sparkContext.broadcast(_block(packed))
    found: list[tuple] = []
    for k, growth in enumerate(growths(name, trials)):
        place = f"{folder}/growth={k}"
        done = _written(spark, place)
        if done is None or len(done) != len(growth.trials) * folds:
            _run(spark, growth, data, folds, seed, weights, len(columns)).write.mode("overwrite").parquet(place)
            done = _written(spark, place)
        found += done
    if isinstance(data, Broadcast):
        data.destroy()
    judged = {t: sum(n for u, _, _, n in found if u == t) for t in range(len(trials))}
    share = {t: float(np.mean([c / n for u, _, c, n in found if u == t and n])) for t in range(len(trials))}
    best = max(share, key=lambda t: (share[t], -t))
    return spark.createDataFrame(
        [(i, {k: str(v) for k, v in t.items()}, share[i], i == best, judged[i]) for i, t in enumerate(trials)],
        "trial int, params map<string,string>, accuracy double, best boolean, n_rows long",
    )


def tune_classifier(
    train: DataFrame,
    model_type: str = "random_forest",
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    seed: int = RANDOM_STATE,
    columns=tuple(FEATURE_COLS),
    by=("ticker",),
    space: dict[str, list] | None = None,
    path: str | None = None,
    max_rows: int | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Best model by mean accuracy, refitted on all rows, and the trial table (see ``search``)."""
    name = model_type_name(model_type)
    table = search(train, name, draws, folds, seed, columns, by, space, path, max_rows)
    best = table.filter("best").first()["trial"]
    params = dict(draw_params(space or SEARCH_SPACES[name], draws, seed)[best])
    return fit_classifier(train, name, int(params.pop(LENGTH[name])), seed, columns, **params), table
