"""Plain gradient boosting over tables of many rows, as Spark's ``GBTClassifier`` fits it.

A tree is fitted to the residuals of the margin so far: a leaf is the mean of its rows, and the first tree, fitted to the
labels, counts whole. Rows are binned once and kept as blocks of packed bytes, dealt evenly by key. Each level of a tree is
one job of one stage: tasks sum residuals and rows of their blocks by (node, column, bin), the sums are added up, and the
driver, which sees no rows, picks the splits. Margins are brought up to date with the blocks every ``KEEP_EVERY`` rounds; the
trees since then are added in the tasks. A table of at most ``ALONE_ROWS`` rows is boosted by one task, which grows the same trees
without a job per level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, functions as F

from barloom.ml.boosting import TREES, BoostedModel, _rows_of, edges_of, pack_rows, packed_tree, unpacked_tree
from barloom.ml.growth import BINS, Growing, Shape, Tree, best_splits, drawn_features, grow, histograms, in_round, node_features, sigmoid
from barloom.ml.scoring import PART_ROWS, dealt

#: Rows that one task boosts alone.
ALONE_ROWS = 100_000
#: Rows of a block, and rows that are worth a task of their own.
BLOCK_ROWS, LEAST_ROWS = 100_000, 5_000
#: Rounds after which the margins of all rows are kept.
KEEP_EVERY = 5
#: Parts up to which the driver adds up the sums of all of them.
PLAIN_PARTS = 64
#: The settings that are known here; boosting with others is Spark's.
KNOWN = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "featureSubsetStrategy", "seed", "featuresCol", "labelCol"}

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # key, label, margin and bins


def is_boosted_here(estimator) -> bool:
    return isinstance(estimator, GBTClassifier) and {p.name for p in estimator.params if estimator.isSet(p)} <= KNOWN


def _blocks(packed: DataFrame, n_rows: int, width: int) -> RDD:
    """The rows in parts of equal size, whose rows stand in the order of their keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            key, y, _, bins = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (key, y, bins)], names=["key", "y", "bins"])

        for batch in batches:
            if batch.num_rows:
                held.append(_rows_of(batch))
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    def block(row) -> Block:
        y = np.frombuffer(row["y"])
        return np.frombuffer(row["key"], dtype=np.int64), y, np.zeros(len(y)), np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(y), width)

    cores = packed.sparkSession.sparkContext.defaultParallelism
    parts = max(min(cores, math.ceil(n_rows / LEAST_ROWS)), math.ceil(n_rows / PART_ROWS))
    rows = packed.repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(pack, "key binary, y binary, bins binary").rdd.map(block)


def _with_trees(margin: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.route(bins)]
    return margin


def _moved(blocks: RDD, trees: list[Tree]) -> RDD:
    """``blocks`` with margins that ``trees`` are added to."""
    return blocks.map(lambda b: (b[0], b[1], _with_trees(b[2], b[3], trees), b[3]))


def _level(blocks: RDD, seed: int, number: int, share: float, pending: list[Tree], growing: Growing | None, features: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Sums of residuals, and rows, by (node, column of the node, bin) of a level's open nodes."""
    partial = place = None
    if growing is not None and growing.levels:
        ends = len(growing.sums[0])
        level = (np.full(ends, -1), np.zeros(ends, int), np.zeros(ends, int), np.zeros(ends), np.zeros(ends))
        partial = Tree(*(np.concatenate(x) for x in zip(*growing.levels, level)))
        place = np.full(growing.made, -1)
        place[growing.made - ends + nodes] = np.arange(len(nodes))

    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((2, *features.shape, BINS))
        for key, y, margin, bins in part:
            taken = in_round(key, seed, number, share)
            y, margin, bins = y[taken], margin[taken], bins[taken]
            g = y - sigmoid(_with_trees(margin, bins, pending))
            node = np.zeros(len(y), dtype=np.int64)
            if partial is not None:
                node = place[partial.route(bins)]
                inside = node >= 0
                node, g, bins = node[inside], g[inside], bins[inside]
            total += np.stack(histograms(bins, node, len(features), features, [g, np.ones(len(g))]))
        yield total

    return blocks.mapPartitions(run).treeReduce(np.add, 1 if blocks.getNumPartitions() <= PLAIN_PARTS else 2)


def _settings(estimator: GBTClassifier, columns: int) -> tuple[Shape, int, float]:
    """The shape of the trees, the seed and the share of rows."""
    shape = Shape(estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), per_node=drawn_features(estimator.getFeatureSubsetStrategy(), columns))
    return shape, estimator.getSeed() & ((1 << 63) - 1), estimator.getSubsamplingRate()


def _factor(step: float, number: int) -> float:
    """What values of tree ``number`` are multiplied by; Spark's residuals are four times these."""
    return 8 * step if number else 4.0


def _boost_alone(packed: DataFrame, estimator: GBTClassifier, columns: int) -> list[Tree]:
    """The trees of ``_boost`` by one task, for a table that is known to fit."""
    shape, seed, share = _settings(estimator, columns)
    rounds, step = estimator.getMaxIter(), estimator.getStepSize()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y, margin, bins = (np.concatenate(x) for x in zip(*[_rows_of(b) for b in batches if b.num_rows]))
        rows = []
        for number in range(rounds):
            n = in_round(key, seed, number, share).astype(float)
            tree = grow(bins, n * (y - sigmoid(margin)), n, n, shape, np.random.default_rng([seed, number]))
            tree.value = tree.value * _factor(step, number)
            margin = _with_trees(margin, bins, [tree])
            rows.append(packed_tree(number, tree))
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["number", "feature", "split", "child", "value", "gain"])

    rows = packed.repartition(1).sortWithinPartitions("key").mapInArrow(run, TREES).collect()
    return [unpacked_tree(r) for r in sorted(rows, key=lambda r: r["number"])]


def _boost(blocks: RDD, estimator: GBTClassifier, columns: int) -> list[Tree]:
    """All rounds; values of the trees are what they add to a margin of which the logistic function is taken, twice Spark's."""
    shape, seed, share = _settings(estimator, columns)
    trees: list[Tree] = []
    pending: list[Tree] = []
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    last: RDD | None = None
    try:
        for number in range(estimator.getMaxIter()):
            if len(pending) == KEEP_EVERY:
                last, blocks, pending = blocks, _moved(blocks, pending).persist(StorageLevel.MEMORY_AND_DISK), []
            rng, all_columns = np.random.default_rng([seed, number]), np.arange(columns)
            growing, nodes = None, np.zeros(1, dtype=np.int64)
            while growing is None or len(nodes):
                features = node_features(shape, all_columns, len(nodes), rng)
                g, n = _level(blocks, seed, number, share, pending, growing, features, nodes)
                if last is not None:  # this job has kept the margins after it
                    last.unpersist()
                    last = None
                if growing is None:
                    growing = Growing(shape, g[0, 0].sum(), n[0, 0].sum(), n[0, 0].sum())
                    if not len(growing.open_nodes()):
                        break
                gain, j, split, *left = best_splits(g, n, n, shape)
                growing.split(nodes, gain, features[np.arange(len(nodes)), j], split, left)
                nodes = growing.open_nodes()
            growing.split(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, int), np.zeros(0, int), [np.zeros(0)] * 3)
            tree = growing.tree()
            tree.value = tree.value * _factor(estimator.getStepSize(), number)
            trees.append(tree)
            pending.append(tree)
    finally:
        for kept in (blocks, last):
            if kept is not None:
                kept.unpersist()
    return trees


def fit_boosting(rows: DataFrame, columns, estimator: GBTClassifier, n_rows: int, label: str = "target") -> BoostedModel:
    """The trees that ``estimator`` describes, over the bins of ``columns``."""
    rows = rows.filter(F.col(label).isNotNull())
    edges = edges_of(rows, columns)
    packed = pack_rows(dealt(rows, n_rows), columns, edges, label)
    if n_rows <= ALONE_ROWS:
        return BoostedModel(columns, edges, _boost_alone(packed, estimator, len(columns)))
    return BoostedModel(columns, edges, _boost(_blocks(packed, n_rows, len(columns)), estimator, len(columns)))
