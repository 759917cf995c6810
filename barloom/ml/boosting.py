"""Second-order boosting: trees on sums of gradients and hessians, with a leaf penalty and columns drawn per tree.

Rows are binned once and written as packed bytes. Each level of a tree is one aggregate keyed by (node,
column, bin): tasks sum gradients, hessians and counts of their rows, Spark adds the sums up, and the
driver, which sees no rows, picks the splits of at most ``2^depth`` nodes. A table of at most ``block_rows`` rows is
boosted by one task, which grows the same trees without a job per level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from barloom.ml.growth import BINS, Boosting, Growing, Shape, Tree, best_splits, boost, gradients, histograms, in_round, node_features, round_columns, sigmoid, to_bins
from barloom.session import cut_lineage

#: Rows that one task boosts alone.
BLOCK_ROWS = 100_000
#: Rounds after which the margins of all rows are written.
WRITE_EVERY = 25
#: Nodes of trees that are saved by one task.
PART_NODES = 1_000_000
#: Accuracy of the quantiles that become bin edges.
EDGE_ACCURACY = 10_000

TREES = "number int, feature binary, split binary, child binary, value binary, gain binary"
KINDS = ("<i4", "<i4", "<i4", "<f8", "<f8")


def packed_tree(number: int, tree: Tree, kinds=KINDS) -> tuple:
    parts = (tree.feature, tree.split, tree.child, tree.value, tree.gain)
    return number, *(np.asarray(x, dtype=k).tobytes() for x, k in zip(parts, kinds))


def unpacked_tree(row, kinds=KINDS) -> Tree:
    return Tree(*(np.frombuffer(bytes(x), dtype=k) for x, k in zip(tuple(row)[1:], kinds)))


def edges_of(rows: DataFrame, columns) -> np.ndarray:
    """Bin edges of each column: values at a quantile grid, by mergeable sketches."""
    grid = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), grid, EDGE_ACCURACY).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    if found[0] is None:
        raise ValueError("no rows to fit")
    return np.array([list(x) for x in found], dtype=float)


def exact_edges(rows: DataFrame, columns, n_rows: int) -> np.ndarray:
    """The edges of ``growth.bin_edges`` over distributed rows, which do not depend on how those are dealt.

    Sketches bracket each value of the grid; tasks count the rows below a bracket and list the values in it, a few in ten
    thousand rows, and each bracket is a group that picks its value by rank.
    """
    if not n_rows:
        raise ValueError("no rows to fit")
    values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = rows.select(*values)
    grid, slack = np.arange(1, BINS) / BINS, 3 / EDGE_ACCURACY + 2 / n_rows
    ends = [float(x) for x in np.clip(np.concatenate([grid - slack, grid + slack]), 0, 1)]
    found = rows.agg(*[F.percentile_approx(c, ends, EDGE_ACCURACY) for c in rows.columns]).first()
    low, high = np.split(np.array([list(x) for x in found], dtype=float), 2, axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            out: list[list[np.ndarray]] = [[], [], []]
            for i in range(len(low)):
                x = np.sort(batch.column(i).to_numpy())
                first, last = np.searchsorted(x, low[i], side="left"), np.searchsorted(x, high[i], side="right")
                for k in range(len(grid)):
                    value, n = np.unique(x[first[k] : last[k]], return_counts=True)
                    # The rows below a bracket stand before all its values.
                    value, n = np.append(-np.inf, value), np.append(first[k], n)
                    for into, part in zip(out, (np.full(len(n), i * len(grid) + k), value, n)):
                        into.append(part)
            edge, value, n = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(edge, pa.int32()), pa.array(value), pa.array(n, pa.int64())], names=["edge", "value", "n"])

    def pick(part: pa.Table) -> pa.Table:
        edge = part["edge"][0].as_py()
        value, n = part["value"].to_numpy(), part["n"].to_numpy()
        order = np.argsort(value, kind="stable")
        value, upto = value[order], n[order].cumsum()
        # The rank that numpy's "lower" quantile has.
        at = value[np.searchsorted(upto, int((n_rows - 1) * grid[edge % len(grid)]), side="right")]
        return pa.table({"edge": pa.array([edge], pa.int32()), "value": pa.array([at])})

    counts = rows.mapInArrow(count, "edge int, value double, n long").groupBy("edge", "value").agg(F.sum("n").alias("n"))
    picked = {r["edge"]: r["value"] for r in counts.groupBy("edge").applyInArrow(pick, "edge int, value double").collect()}
    return np.array([picked[k] for k in range(low.size)]).reshape(low.shape)


def pack_rows(rows: DataFrame, columns, edges: np.ndarray, label: str = "target", key: str | None = None) -> DataFrame:
    """``key, y, margin, bins``: a number (or the column ``key``), the label, a margin of 0 and a byte per column; written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)
            bins = to_bins(np.nan_to_num(x.astype(float)), edges)
            offsets = np.arange(n + 1, dtype=np.int32) * len(columns)
            packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(bins.tobytes())])
            y = batch.column(len(columns)).cast(pa.float64())
            number = pa.array(np.arange(made, made + n)) if key is None else batch.column(len(columns) + 1)
            yield pa.RecordBatch.from_arrays([number, y, pa.array(np.zeros(n)), packed], names=["key", "y", "margin", "bins"])
            made += n

    wanted = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    if key is not None:
        rows = rows.select(*wanted, F.col(label).alias("y"), F.col(key).alias("key"))
    else:
        rows = rows.select(*wanted, F.col(label).alias("y"))
    return cut_lineage(rows.mapInArrow(pack, "key long, y double, margin double, bins binary"))


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    key, y, margin = (batch.column(i).to_numpy() for i in range(3))
    packed = batch.column(3)
    _, offsets, data = packed.buffers()
    wide = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=wide)[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(data or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return key, y, margin, flat.reshape(len(key), -1)


def _boost_alone(packed: DataFrame, settings: Boosting) -> list[Tree]:
    """All rounds in one task, for a table that is known to fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_rows_of(b) for b in batches if b.num_rows]
        key, y, _, bins = (np.concatenate(x) for x in zip(*parts))
        trees, _ = boost(bins, y, key, settings)
        rows = [packed_tree(i, t) for i, t in enumerate(trees)]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["number", "feature", "split", "child", "value", "gain"])

    rows = packed.repartition(1).sortWithinPartitions("key").mapInArrow(run, TREES).collect()
    return [unpacked_tree(r) for r in sorted(rows, key=lambda r: r["number"])]


def _level(packed: DataFrame, settings: Boosting, pending: list[Tree], number: int, growing: Growing | None, features: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Histograms of the open nodes of a level: sums of gradients, hessians and rows by (node, column of the node, bin)."""
    width, place = BINS, None
    partial = first = None
    if growing is not None and growing.levels:
        first = growing.made - len(growing.sums[0])
        ends = len(growing.sums[0])
        levels = [*growing.levels, (np.full(ends, -1), np.zeros(ends, int), np.zeros(ends, int), np.zeros(ends), np.zeros(ends))]
        partial = Tree(*(np.concatenate(x) for x in zip(*levels)))
        place = np.full(ends, -1)
        place[nodes] = np.arange(len(nodes))
    count = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in (b for b in batches if b.num_rows):
            key, y, margin, bins = _rows_of(batch)
            taken = in_round(key, settings.seed, number, settings.rows)
            y, margin, bins = y[taken], margin[taken], bins[taken]
            for tree in pending:
                margin = margin + tree.value[tree.route(bins)]
            g, h = gradients(margin, y)
            node = np.zeros(len(y), dtype=np.int64)
            if partial is not None:
                at = partial.route(bins) - first
                node = np.where(at >= 0, place[np.maximum(at, 0)], -1)
                inside = node >= 0
                node, g, h, bins = node[inside], g[inside], h[inside], bins[inside]
            sums = np.stack([x.ravel() for x in histograms(bins, node, count, features, [g, h, np.ones(len(g))], width)])
            total = sums if total is None else total + sums
        if total is not None:
            cell = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(t[cell]) for t in total)], names=["cell", "g", "h", "n"])

    rows = packed.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = []
    for name in ("g", "h", "n"):
        flat = np.zeros(features.size * width)
        flat[rows["cell"].to_numpy()] = rows[name].to_numpy()
        out.append(flat.reshape(*features.shape, width))
    return out


def _boost_together(packed: DataFrame, settings: Boosting, n_columns: int) -> list[Tree]:
    """One aggregate per level of each tree; margins are written every so often, trees since then are added in the tasks."""
    trees: list[Tree] = []
    pending: list[Tree] = []
    for number in range(settings.rounds):
        if len(pending) == WRITE_EVERY:
            packed, pending = cut_lineage(_with_margins(packed, pending)), []
        columns = round_columns(settings, number, n_columns)
        rng, growing, nodes = np.random.default_rng([settings.seed, number]), None, np.zeros(1, dtype=np.int64)
        sums: list[tuple[np.ndarray, np.ndarray]] = []  # gradients and hessians of the nodes of each level
        while growing is None or len(nodes):
            features = node_features(settings.shape, columns, len(nodes), rng)
            g, h, n = _level(packed, settings, pending, number, growing, features, nodes)
            worth = h if settings.second_order else n
            if growing is None:
                growing = Growing(settings.shape, *(x[0, 0].sum() for x in (g, worth, n)))
                sums.append((growing.sums[0], h[0, :1].sum(axis=1)))
                if not len(growing.open_nodes()):
                    break
            gain, j, split, *left = best_splits(g, worth, n, settings.shape)
            node, kept = np.arange(len(nodes)), np.isfinite(gain)
            low = h.cumsum(axis=2)[node, j, split][kept]
            growing.split(nodes, gain, features[node, j], split, left)
            sums.append((growing.sums[0], np.stack([low, sums[-1][1][nodes[kept]] - low], axis=1).ravel()))
            nodes = growing.open_nodes()
        growing.split(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, int), np.zeros(0, int), [np.zeros(0)] * 3)
        tree = growing.tree()
        if not settings.second_order:  # splits weigh rows, leaves hessians
            top, bottom = (np.concatenate(x) for x in zip(*sums))
            tree.value = np.divide(top, bottom, out=np.zeros_like(top), where=(bottom > 1e-12) & (tree.feature < 0))
        tree.value = tree.value * settings.step
        trees.append(tree)
        pending.append(tree)
    return trees


def _with_margins(packed: DataFrame, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            _, _, margin, bins = _rows_of(batch)
            for tree in trees:
                margin = margin + tree.value[tree.route(bins)]
            yield batch.set_column(2, "margin", pa.array(margin))

    return packed.mapInArrow(run, packed.schema)


class Inputs:
    """The feature columns of a model, as the first stage of a pipeline names them."""

    def __init__(self, columns):
        self.columns = list(columns)

    def getInputCols(self) -> list[str]:
        return self.columns


class BoostedModel:
    """Boosted trees over binned columns, used like a fitted pipeline: ``transform``, ``stages`` and ``write``."""

    folder, kinds = "boosted", KINDS

    def __init__(self, columns, edges: np.ndarray, trees: list[Tree], base: float = 0.0):
        self.columns, self.edges, self.trees, self.base = list(columns), edges, trees, base
        self.stages = [Inputs(columns), None, self]
        self._uri, self._mode = None, "error"

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Gains of the splits of each column, as shares."""
        total = np.zeros(len(self.columns))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def chance(self, bins: np.ndarray) -> np.ndarray:
        """Probability of the class 1 of binned rows."""
        margin = np.full(len(bins), self.base)
        for tree in self.trees:
            margin += tree.value[tree.route(bins)]
        return sigmoid(margin)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` (of both classes) and ``prediction``; nothing is shuffled."""
        edges, chance, n = self.edges, self.chance, len(self.columns)

        @arrow_udf("double")
        def up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                yield pa.array(chance(to_bins(x, edges)))

        values = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.columns])
        scored = rows.withColumn("_up", up(values))
        both = array_to_vector(F.array(F.lit(1.0) - F.col("_up"), F.col("_up")))
        return scored.withColumn("probability", both).withColumn("prediction", (F.col("_up") > 0.5).cast("double")).drop("_up")

    def write(self) -> BoostedModel:
        return self

    def overwrite(self) -> BoostedModel:
        self._mode = "overwrite"
        return self

    def save(self, uri: str) -> None:
        spark, mode = SparkSession.active(), self._mode
        self._mode = "error"
        rows = [packed_tree(i, t, self.kinds) for i, t in enumerate(self.trees)]
        parts = 1 + sum(len(t.feature) for t in self.trees) // PART_NODES
        # Rows of the driver travel inside tasks, which may not be larger than a message.
        table = spark.createDataFrame(rows, TREES).coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), TREES)
        meta = [(self.columns, self.edges.ravel().tolist(), self.base)]
        # The trees come last: a model without them does not load.
        spark.createDataFrame(meta, "columns array<string>, edges array<double>, base double").coalesce(1).write.mode(mode).parquet(f"{uri}/{self.folder}/meta")
        table.write.mode(mode).parquet(f"{uri}/{self.folder}/trees")

    @classmethod
    def load(cls, uri: str) -> BoostedModel | None:
        """The model at ``uri``, None where there is none of this kind."""
        spark = SparkSession.active()
        try:
            rows = spark.read.schema(TREES).parquet(f"{uri}/{cls.folder}/trees").orderBy("number").collect()
        except AnalysisException:
            return None
        meta = spark.read.parquet(f"{uri}/{cls.folder}/meta").first()
        return cls(meta["columns"], np.array(meta["edges"]).reshape(len(meta["columns"]), -1), [unpacked_tree(r, cls.kinds) for r in rows], meta["base"])


class SecondOrder:
    """Settings of second-order boosting under the names that Spark's estimators have."""

    def __init__(self, seed: int, maxIter: int, maxDepth: int = 6, stepSize: float = 0.3, subsamplingRate: float = 1.0, featureSubsetStrategy: str = "1.0", minInstancesPerNode: float = 1, minInfoGain: float = 0.0, penalty: float = 1.0):
        self.least = minInstancesPerNode
        share = 1.0 if featureSubsetStrategy == "all" else float(featureSubsetStrategy)
        # The least of a side is a sum of hessians. The loss is halved in the gain that minInfoGain bounds.
        shape = Shape(int(maxDepth), 1, float(minInstancesPerNode), float(penalty), 2 * float(minInfoGain))
        self.settings = Boosting(int(maxIter), float(stepSize), shape, float(subsamplingRate), share, True, int(seed))

    def getMinInstancesPerNode(self) -> float:
        return self.least

    def getMaxIter(self) -> int:
        return self.settings.rounds

    def fit(self, rows: DataFrame, columns, label: str = "target", block_rows: int = BLOCK_ROWS) -> BoostedModel:
        rows = rows.filter(F.col(label).isNotNull())
        edges = edges_of(rows, columns)
        packed = pack_rows(rows, columns, edges, label)
        if packed.count() <= block_rows:
            trees = _boost_alone(packed, self.settings)
        else:
            trees = _boost_together(packed, self.settings, len(columns))
        return BoostedModel(columns, edges, trees, self.settings.base)
