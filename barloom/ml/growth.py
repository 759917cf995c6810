"""Trees grown level by level on histograms of binned features.

One kernel serves forests and boosting. Every row brings ``g``, ``h`` and a count; a node is worth ``G / (H +
penalty)`` and a split gains ``GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty)``. With weighted labels as ``g`` and weights
as ``h`` that is the Gini gain of a classification tree, with gradients and hessians the gain of second-order
boosting. The functions here work on bounded blocks of rows inside tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Shape:
    """What a tree may look like."""

    max_depth: int = 5
    min_rows: int = 1  # rows on each side of a split
    min_hess: float = 0.0  # sum of h on each side
    penalty: float = 0.0
    min_gain: float = 0.0
    per_node: int | None = None  # features drawn for each node; None takes all


@dataclass
class Tree:
    """Nodes in breadth-first order; a leaf has feature -1, the right child follows the left one."""

    feature: np.ndarray
    split: np.ndarray  # the last bin that goes left
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def route(self, bins: np.ndarray, depths: list[int] | None = None) -> np.ndarray | list[np.ndarray]:
        """Nodes that rows end in, or those they are in at each of the given depths."""
        node, row, seen = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins)), {}
        deepest = max(depths) if depths else len(self.feature)
        for depth in range(deepest):
            if depths and depth in depths:
                seen[depth] = node.copy()
            inner = self.feature[node[row]] >= 0
            row = row[inner]
            if not len(row):
                break
            at = node[row]
            node[row] = self.child[at] + (bins[row, self.feature[at]] > self.split[at])
        return node if depths is None else [seen.get(d, node) for d in depths]


def bin_edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Values of a quantile grid per column: ``[columns, bins - 1]``."""
    return np.ascontiguousarray(np.quantile(x, np.arange(1, bins) / bins, axis=0, method="lower").T)


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of edges below each value."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i in range(x.shape[1]):
        out[:, i] = np.searchsorted(edges[i], x[:, i], side="left")
    return out


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """The best split of each node of histograms ``[nodes, features, bins]``.

    Returns gain (minus infinity where none is allowed), feature and bin, and the sums of the left side. Of equal gains the first
    feature and bin win.
    """
    left = [np.cumsum(x, axis=2)[:, :, :-1] for x in (g, h, n)]
    total = [x.sum(axis=2)[:, :1, None] for x in (g, h, n)]
    right = [t - x for t, x in zip(total, left)]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + shape.penalty) + right[0] ** 2 / (right[1] + shape.penalty) - total[0] ** 2 / (total[1] + shape.penalty)
    least = max(shape.min_rows, 1)
    able = (left[2] >= least) & (right[2] >= least) & (left[1] >= shape.min_hess) & (right[1] >= shape.min_hess) & (gain > max(shape.min_gain, 1e-9))
    gain = np.where(able, gain, -np.inf).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    feature, split = np.divmod(best, g.shape[2] - 1)
    node = np.arange(len(g))
    return gain[node, best], feature, split, *(x[node, feature, split] for x in left)


class Growing:
    """A tree under way: histograms go in, one level of splits comes out."""

    def __init__(self, shape: Shape, g: float, h: float, n: float):
        self.shape = shape
        self.sums = [np.array([x], dtype=float) for x in (g, h, n)]  # of the nodes of this level
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.depth, self.made = 0, 1

    def open_nodes(self) -> np.ndarray:
        """Nodes of this level that may be split, numbered within the level."""
        g, h, n = self.sums
        if self.depth >= self.shape.max_depth:
            return np.zeros(0, dtype=np.int64)
        pure = (g == 0) | (g == h) if self.shape.min_hess == 0 and self.shape.penalty == 0 else np.zeros(len(g), dtype=bool)
        return np.flatnonzero((n >= 2 * max(self.shape.min_rows, 1)) & (h >= 2 * self.shape.min_hess) & ~pure)

    def split(self, nodes: np.ndarray, gain: np.ndarray, feature: np.ndarray, at: np.ndarray, left: list[np.ndarray]) -> np.ndarray:
        """Ends the level with the splits of ``nodes`` that gain; returns for each of those its left child within the next level, or -1."""
        g, h, n = self.sums
        kept = np.isfinite(gain)
        chosen = nodes[kept]
        features, splits, children, gains = (np.full(len(g), -1), np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64), np.zeros(len(g)))
        features[chosen], splits[chosen], gains[chosen] = feature[kept], at[kept], gain[kept]
        order = np.full(len(nodes), -1)
        order[kept] = 2 * np.arange(kept.sum())
        children[chosen] = self.made + order[kept]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.nan_to_num(g / (h + self.shape.penalty))
        self.levels.append((features, splits, children, value, gains))
        self.sums = [np.stack([x[kept], s[chosen] - x[kept]], axis=1).ravel() for x, s in zip(left, self.sums)]
        self.made += len(self.sums[0])
        self.depth += 1
        return order

    def tree(self) -> Tree:
        parts = [np.concatenate(x) for x in zip(*self.levels)]
        return Tree(*(p.astype(np.int32) for p in parts[:3]), *parts[3:])


def histograms(bins: np.ndarray, node: np.ndarray, nodes: int, features: np.ndarray, weights: list[np.ndarray], width: int = BINS) -> list[np.ndarray]:
    """Sums of each weight by node, feature of the node (``features[nodes, m]``) and bin."""
    m = features.shape[1]
    code = bins[np.arange(len(bins))[:, None], features[node]] + (node[:, None] * m + np.arange(m)) * width
    code = code.ravel()
    return [np.bincount(code, np.repeat(w, m), minlength=nodes * m * width).reshape(nodes, m, width) for w in weights]


def node_features(shape: Shape, columns: np.ndarray, nodes: int, rng: np.random.Generator) -> np.ndarray:
    """The features that each of some nodes may be split by: ``[nodes, features]``."""
    if shape.per_node and shape.per_node < len(columns):
        drawn = rng.random((nodes, len(columns))).argpartition(shape.per_node - 1, axis=1)[:, : shape.per_node]
        return columns[drawn]
    return np.broadcast_to(columns, (nodes, len(columns)))


def class_sums(up: np.ndarray, n: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """``g``, ``h`` and count of numbers of rows, those of class 1 and all, with the weights of both classes."""
    g = weights[1] * up
    return g, g + weights[0] * (n - up), n


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray | None, n: np.ndarray, shape: Shape, rng: np.random.Generator, columns: np.ndarray | None = None, weights: tuple[float, float] | None = None) -> Tree:
    """One tree over rows of which ``n`` are in it (0 leaves a row out). Deeper shapes begin with the same levels.

    With ``weights`` of the classes ``g`` is the part of ``n`` in class 1 and ``h`` is not used. Whole numbers are summed then, so
    the tree does not depend on the order of the rows.
    """
    columns = np.arange(bins.shape[1]) if columns is None else columns
    counted = [g, h, n] if weights is None else [g, n]

    def sums(parts: list) -> list:
        return parts if weights is None else class_sums(*parts, weights)

    rows = np.flatnonzero(n > 0)
    at = np.zeros(len(rows), dtype=np.int64)
    growing = Growing(shape, *sums([x[rows].sum() for x in counted]))
    while True:
        nodes = growing.open_nodes()
        place = np.full(len(growing.sums[0]), -1)
        place[nodes] = np.arange(len(nodes))
        k = place[at]
        rows, k = rows[k >= 0], k[k >= 0]
        if not len(nodes):
            growing.split(nodes, np.zeros(0), np.zeros(0, int), np.zeros(0, int), [np.zeros(0)] * 3)
            return growing.tree()
        features = node_features(shape, columns, len(nodes), rng)
        found = best_splits(*sums(histograms(bins[rows], k, len(nodes), features, [x[rows] for x in counted])), shape)
        gain, j, split = found[:3]
        feature = features[np.arange(len(nodes)), j]
        order = growing.split(nodes, gain, feature, split, list(found[3:]))
        stays = order[k] >= 0
        rows, k = rows[stays], k[stays]
        at = order[k] + (bins[rows, feature[k]] > split[k])


def drawn_features(strategy: str, n: int) -> int | None:
    """Features per node for Spark's names of strategies."""
    if strategy in ("all", "auto"):
        return None
    share = {"sqrt": np.sqrt(n), "log2": np.log2(n), "onethird": n / 3}.get(strategy)
    return min(n, max(1, int(np.ceil(share if share is not None else float(strategy) * n))))


def forest_tree(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, shape: Shape, share: float, seed: int, number: int) -> Tree:
    """Tree ``number`` of a forest: rows drawn with replacement, then grown; it depends on no other tree."""
    rng = np.random.default_rng([seed, number])
    n = np.bincount(rng.integers(len(y), size=max(1, round(share * len(y)))), minlength=len(y)).astype(float)
    return grow(bins, n * weight * y, n * weight, n, shape, rng)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Boosting:
    """Settings of boosted trees; ``second_order`` sums hessians where plain gradient boosting counts rows."""

    rounds: int
    step: float
    shape: Shape
    rows: float = 1.0  # share of rows per tree
    columns: float = 1.0  # share of columns per tree
    second_order: bool = True
    seed: int = 0
    base: float = field(default=0.0)


def in_round(key: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round, by a hash of its key."""
    return np.ones(len(key), dtype=bool) if share >= 1 else hashed(key, seed, number) < share


def times_drawn(key: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """How often a row is in a tree of a forest: a Poisson number with that mean, by a hash of its key."""
    chance = np.cumsum([math.exp(-share) * share**k / math.factorial(k) for k in range(100)])
    return np.searchsorted(chance, hashed(key, seed, number), side="right").astype(np.uint8)


def hashed(key: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number from 0 to 1 for each key."""
    U = np.uint64
    x = key.astype(U) * U(0x9E3779B97F4A7C15) + U((seed * 1_000_003 + number) * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return ((x ^ (x >> U(31))) >> U(11)).astype(float) / (1 << 53)


def round_columns(settings: Boosting, number: int, n: int) -> np.ndarray:
    """The columns of a round's tree."""
    take = max(1, int(settings.columns * n))
    return np.sort(np.random.default_rng([settings.seed, number, n]).permutation(n)[:take])


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradient and hessian of the log loss."""
    p = sigmoid(margin)
    return y - p, p * (1 - p)


def boost(bins: np.ndarray, y: np.ndarray, key: np.ndarray, settings: Boosting, watch: np.ndarray | None = None, at: tuple[int, ...] = ()) -> tuple[list[Tree], dict[int, np.ndarray]]:
    """All rounds over one block; margins of the rows ``watch`` after the rounds ``at``."""
    margin = np.full(len(y), settings.base)
    watched = None if watch is None else np.full(len(watch), settings.base)
    trees, seen = [], {}
    for number in range(settings.rounds):
        g, h = gradients(margin, y)
        n = in_round(key, settings.seed, number, settings.rows).astype(float)
        if settings.second_order:
            tree = grow(bins, g * n, h * n, n, settings.shape, np.random.default_rng([settings.seed, number]), round_columns(settings, number, bins.shape[1]))
        else:
            tree = grow(bins, g * n, n, n, settings.shape, np.random.default_rng([settings.seed, number]))
            leaf = tree.route(bins)
            top, bottom = np.bincount(leaf, g * n, len(tree.value)), np.bincount(leaf, h * n, len(tree.value))
            tree.value = np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 1e-12)
        tree.value = tree.value * settings.step
        margin += tree.value[tree.route(bins)]
        if watched is not None:
            watched += tree.value[tree.route(watch)]
        trees.append(tree)
        if number + 1 in at:
            seen[number + 1] = watched.copy()
    return trees, seen
