"""Random forests over tables of many rows.

Rows are binned once and written as packed bytes. Nodes of more than ``NODE_ROWS`` rows are split level by level, all
trees of a batch together: tasks count their rows by (tree, node, column, bin), Spark adds the counts up, and the driver,
which sees no rows, picks the splits. Every smaller node is a group: Spark deals its rows to one task, which grows
all that stands below it. So the passes over the table grow with the logarithm of its rows and not with the nodes of
the trees, and no histogram of a small node is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F

from barloom.ml.boosting import TREES, BoostedModel, _rows_of, edges_of, pack_rows, packed_tree, unpacked_tree
from barloom.ml.growth import BINS, Growing, Shape, Tree, best_splits, class_sums, drawn_features, grow, histograms, node_features, times_drawn
from barloom.ml.scoring import dealt

#: Rows of a node that one task grows.
NODE_ROWS = 50_000
#: Rows of all trees of a batch, which are dealt together.
BATCH_ROWS = 25_000_000
#: Rows that a task packs together.
PACK_ROWS = 100_000
#: Depth 15 makes trees of up to 65,535 nodes, so they are kept as 14 bytes a node.
KINDS = ("<i1", "<u1", "<i4", "<f4", "<f4")
#: The settings that are known here; a forest with others is Spark's.
KNOWN = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "subsamplingRate", "seed", "weightCol", "featuresCol", "labelCol"}


def is_grown_here(estimator, columns) -> bool:
    own = isinstance(estimator, RandomForestClassifier)
    return own and len(columns) < 128 and {p.name for p in estimator.params if estimator.isSet(p)} <= KNOWN


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, labels and bins of some ``PACK_ROWS`` rows at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_rows_of(batch))
            size += batch.num_rows
        if size >= PACK_ROWS:
            key, y, _, bins = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            yield key, y > 0.5, bins
    if held:
        key, y, _, bins = (np.concatenate(x) for x in zip(*held))
        yield key, y > 0.5, bins


class _Top:
    """The nodes of one tree that are split by aggregates."""

    def __init__(self, seed: int, number: int, shape: Shape, columns: int):
        self.rng, self.shape, self.columns = np.random.default_rng([seed, number]), shape, np.arange(columns)
        self.growing: Growing | None = None
        self.rest: list[tuple[int, int]] = []  # number and depth of the nodes that are left to a task
        self.nodes = np.zeros(1, dtype=np.int64)
        self.features = node_features(shape, self.columns, 1, self.rng)

    def tree(self) -> Tree:
        """What is split so far; the nodes of the level under way are its last ones."""
        if self.growing is None:
            return Tree(np.full(1, -1), *np.zeros((2, 1), dtype=int), *np.zeros((2, 1)))
        ends = len(self.growing.sums[0])
        level = (np.full(ends, -1), np.zeros(ends, int), np.zeros(ends, int), np.zeros(ends), np.zeros(ends))
        return Tree(*(np.concatenate(x) for x in zip(*self.growing.levels, level)))

    def place(self) -> np.ndarray:
        """The place of each node of the tree among those that are counted, or -1."""
        if self.growing is None:
            return np.zeros(1, dtype=np.int64)
        place = np.full(self.growing.made, -1)
        place[self.growing.made - len(self.growing.sums[0]) + self.nodes] = np.arange(len(self.nodes))
        return place

    def split(self, up: np.ndarray, n: np.ndarray, weights: tuple[float, float]) -> None:
        """Ends a level with the counts of rows, ``up`` and all, of its nodes."""
        g, h, n = class_sums(up, n, weights)
        if self.growing is None:
            self.growing = Growing(self.shape, g[0, 0].sum(), h[0, 0].sum(), n[0, 0].sum())
            if not len(self.growing.open_nodes()):
                self._end()
                return
        gain, j, at, *left = best_splits(g, h, n, self.shape)
        self.growing.split(self.nodes, gain, self.features[np.arange(len(self.nodes)), j], at, left)
        nodes, rows = self.growing.open_nodes(), self.growing.sums[2]
        first = self.growing.made - len(rows)
        self.rest += [(int(first + k), self.growing.depth) for k in nodes[rows[nodes] <= NODE_ROWS]]
        self.nodes = nodes[rows[nodes] > NODE_ROWS]
        self.features = node_features(self.shape, self.columns, len(self.nodes), self.rng)
        if not len(self.nodes):
            self._end()

    def _end(self) -> None:
        self.nodes = np.zeros(0, dtype=np.int64)
        self.growing.split(self.nodes, np.zeros(0), np.zeros(0, int), np.zeros(0, int), [np.zeros(0)] * 3)

    def ended(self) -> Tree:
        return self.tree() if self.growing is None else self.growing.tree()


def _count(packed: DataFrame, tops: dict[int, _Top], seed: int, share: float) -> dict[int, list[np.ndarray]]:
    """Rows by (node, column, bin) of each tree: those with label 1, and all."""
    asked = {k: (t.tree(), t.place(), t.features) for k, t in tops.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: 0 for k in asked}
        for key, y, bins in _blocks(batches):
            for k, (tree, place, features) in asked.items():
                n = times_drawn(key, seed, k, share).astype(float)
                node = place[tree.route(bins)]
                inside = (n > 0) & (node >= 0)
                n = n[inside]
                sums = histograms(bins[inside], node[inside], len(features), features, [n * y[inside], n])
                total[k] = total[k] + np.stack([x.ravel() for x in sums])
        for k, sums in total.items():
            if isinstance(sums, np.ndarray):
                cell = np.flatnonzero(sums[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(sums[0][cell]), pa.array(sums[1][cell])], names=["tree", "cell", "up", "n"])

    rows = packed.mapInArrow(run, "tree int, cell long, up double, n double")
    rows = rows.groupBy("tree", "cell").agg(F.sum("up").alias("up"), F.sum("n").alias("n")).toArrow()
    tree, cell = rows["tree"].to_numpy(), rows["cell"].to_numpy()
    out = {}
    for k, (_, _, features) in asked.items():
        here = tree == k
        out[k] = []
        for name in ("up", "n"):
            flat = np.zeros(features.size * BINS)
            flat[cell[here]] = rows[name].to_numpy()[here]
            out[k].append(flat.reshape(*features.shape, BINS))
    return out


def _grow_below(bins: np.ndarray, n: np.ndarray, y: np.ndarray, shape: Shape, seed: int, number: int, node: int, depth: int, weights: tuple[float, float]) -> Tree:
    """What stands at a node of tree ``number`` and below it, from the rows that reach it."""
    below = Shape(shape.max_depth - depth, shape.min_rows, per_node=shape.per_node)
    return grow(bins, n * y, None, n, below, np.random.default_rng([seed, number, 1 + node]), weights=weights)


def _grow_rest(packed: DataFrame, tops: dict[int, _Top], seed: int, share: float, shape: Shape, weights: tuple[float, float], width: int) -> DataFrame:
    """``tree, node`` and what grows below that node, for the nodes that tasks grow."""
    asked = {}
    for k, top in tops.items():
        tree = top.ended()
        place, depths = np.full(len(tree.feature), -1), np.zeros(len(tree.feature), dtype=np.int64)
        for node, depth in top.rest:
            place[node], depths[node] = node, depth
        asked[k] = tree, place, depths

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, y, bins in _blocks(batches):
            for k, (tree, place, depths) in asked.items():
                n = times_drawn(key, seed, k, share)
                node = place[tree.route(bins)]
                rows = np.flatnonzero((n > 0) & (node >= 0))
                if not len(rows):
                    continue
                rows = rows[np.argsort(node[rows], kind="stable")]
                nodes, starts = np.unique(node[rows], return_index=True)
                parts = np.split(rows, starts[1:])
                columns = [[x[r].tobytes() for r in parts] for x in (n, y.astype(np.uint8), bins)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(nodes), k, np.int32)), pa.array(nodes.astype(np.int32)), pa.array(depths[nodes].astype(np.int32)), pa.array(np.full(len(nodes), key[0]))]
                    + [pa.array(c, pa.binary()) for c in columns],
                    names=["tree", "node", "depth", "first", "n", "y", "bins"],
                )

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("first")  # whatever order the parts came in
        k, node, depth = (rows[c][0].as_py() for c in ("tree", "node", "depth"))
        n, y, bins = (np.frombuffer(b"".join(rows[c].to_pylist()), dtype=np.uint8) for c in ("n", "y", "bins"))
        tree = _grow_below(bins.reshape(len(n), width), n.astype(float), y, shape, seed, k, node, depth, weights)
        _, *parts = packed_tree(k, tree, KINDS)
        made = [pa.array([k], pa.int32()), pa.array([node], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)]
        return pa.table(made, names=["tree", "node", "feature", "split", "child", "value", "gain"])

    dealt = packed.mapInArrow(deal, "tree int, node int, depth int, first long, n binary, y binary, bins binary")
    return dealt.groupBy("tree", "node").applyInArrow(finish, "tree int, node int, feature binary, split binary, child binary, value binary, gain binary")


def _whole(top: Tree, below: dict[int, Tree]) -> Tree:
    """``top`` with the trees that were grown at its nodes."""
    top = Tree(*(np.array(x) for x in (top.feature, top.split, top.child, top.value, top.gain)))
    parts, made = [top], len(top.feature)
    for node, tree in below.items():
        child = np.where(tree.feature >= 0, tree.child + made - 1, 0)
        for into, x in zip((top.feature, top.split, top.child, top.value, top.gain), (tree.feature, tree.split, child, tree.value, tree.gain)):
            into[node] = x[0]
        parts.append(Tree(*(x[1:] for x in (tree.feature, tree.split, child, tree.value, tree.gain))))
        made += len(tree.feature) - 1
    joined = (np.concatenate([getattr(p, name) for p in parts]) for name in ("feature", "split", "child", "value", "gain"))
    return Tree(*(x.astype(k) for x, k in zip(joined, KINDS)))


def grown_trees(packed: DataFrame, n_rows: int, first: int, last: int, shape: Shape, seed: int, share: float, weights: tuple[float, float], width: int) -> list[Tree]:
    """Trees ``first`` to ``last`` of a forest over packed rows, of one batch."""
    tops = {k: _Top(seed, k, shape, width) for k in range(first, last)}
    if n_rows * share <= NODE_ROWS:
        for top in tops.values():
            top.rest.append((0, 0))
    else:
        while going := {k: t for k, t in tops.items() if len(t.nodes)}:
            for k, sums in _count(packed, going, seed, share).items():
                tops[k].split(*sums, weights)
    below = {k: {} for k in tops}
    for r in _grow_rest(packed, tops, seed, share, shape, weights, width).collect():
        below[r["tree"]][r["node"]] = unpacked_tree(tuple(r)[1:], KINDS)
    return [_whole(top.ended(), dict(sorted(below[k].items()))) for k, top in tops.items()]


def block_tree(key: np.ndarray, y: np.ndarray, bins: np.ndarray, number: int, shape: Shape, seed: int, share: float, weights: tuple[float, float]) -> Tree:
    """Tree ``number`` of a forest over rows at hand, the same one as ``grown_trees`` makes of them; it depends on no other tree."""
    n = times_drawn(key, seed, number, share).astype(float)
    top = _Top(seed, number, shape, bins.shape[1])
    if len(key) * share <= NODE_ROWS:
        top.rest.append((0, 0))
    else:
        drawn = n > 0
        n, y, bins = n[drawn], y[drawn], bins[drawn]
        while len(top.nodes):
            node = top.place()[top.tree().route(bins)]
            inside = node >= 0
            up, every = histograms(bins[inside], node[inside], len(top.nodes), top.features, [n[inside] * y[inside], n[inside]])
            top.split(up, every, weights)
    tree, below = top.ended(), {}
    at = tree.route(bins)
    for node, depth in sorted(top.rest):
        own = at == node
        below[node] = _grow_below(bins[own], n[own], y[own], shape, seed, number, node, depth, weights)
    return _whole(tree, below)


def fit_forest(rows: DataFrame, columns, estimator: RandomForestClassifier, n_rows: int, label: str = "target") -> ForestModel:
    """The forest that ``estimator`` describes, with balanced class weights if it has a weight column."""
    shape = Shape(estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), per_node=drawn_features(_strategy(estimator), len(columns)))
    trees, seed, share = estimator.getNumTrees(), estimator.getSeed() & ((1 << 63) - 1), estimator.getSubsamplingRate()
    rows = rows.filter(F.col(label).isNotNull())
    edges = edges_of(rows, columns)
    packed = pack_rows(dealt(rows, n_rows), columns, edges, label)
    n, up = packed.agg(F.count(F.lit(1)), F.sum("y")).first()
    weights = (n / (2 * max(n - up, 1)), n / (2 * max(up, 1))) if estimator.isSet("weightCol") else (1.0, 1.0)
    made: list[Tree] = []
    step = max(1, BATCH_ROWS // n)
    for first in range(0, trees, step):
        made += grown_trees(packed, n, first, min(first + step, trees), shape, seed, share, weights, len(columns))
    return ForestModel(columns, edges, made)


def _strategy(estimator: RandomForestClassifier) -> str:
    """Spark's ``auto`` is the square root for several trees and all features for one."""
    name = estimator.getFeatureSubsetStrategy()
    return ("sqrt" if estimator.getNumTrees() > 1 else "all") if name == "auto" else name


class ForestModel(BoostedModel):
    """Trees whose votes are averaged, used like a fitted pipeline."""

    folder, kinds = "forest", KINDS

    @property
    def featureImportances(self) -> DenseVector:
        """Gains of the splits of each column, as shares of each tree, averaged."""
        total = np.zeros(len(self.columns))
        for tree in self.trees:
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], tree.gain[inner], len(self.columns))
            total += own / own.sum() if own.sum() > 0 else 0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def chance(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees:
            total += tree.value[tree.route(bins)]
        return np.clip(total / len(self.trees), 0.0, 1.0)
