"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a few bits by BK-trees.

Equal fingerprints are one class. Two fingerprints at most ``radius`` bits apart agree in at least
``bands - radius`` of ``bands`` slices of their bits, so classes are dealt into shards by every choice of
that many slices; wider choices are taken for more classes, so that shards stay small. In every shard
the fingerprints form a BK-tree (a child hangs on its parent by their Hamming distance) and each of
them is searched in it, following only edges whose distance differs from its own by ``radius`` or less.
All trees of a task are walked together, level by level, in arrays.

A shard of more than ``BLOCK`` fingerprints is cut into blocks; each block's tree goes to the rows of
each block once, so no task holds more than two blocks of it, and no link is lost. A task returns a
spanning star for each of its groups instead of the pairs. The stars of all shards are joined into
components by alternating large-star and small-star steps, whose tables lie in the shared folder.

Defined results: a NULL or wordless text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; equal rows get equal results; rows that share an id are one
document for the grouping; rows without id get their fingerprint and no component; no rows give no
rows; only the named columns are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from barloom.llm.common import ASCII_LOWER, free_name, ranges, release, small_batches, stored

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one shard that stand in one tree.
BLOCK = 2048
#: Fingerprints of a shard that are welcome on average; beyond that more slices must agree.
SHARD = 64
#: Rows that one task gets.
TASK_ROWS = 20_000
#: Pairs of query and node that are looked at together.
FRONT = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = text.translate(ASCII_LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    count, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 17):
        part = slice(at, min(at + (1 << 17), count))
        spans = zip(starts[part].tolist(), ends[shingle - 1 :][part].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long (the same 64 bits)."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        found = np.fromiter((fingerprint(raw[i].as_py(), shingle) for i in range(len(raw))), dtype=np.uint64, count=len(raw))
        release()
        return pa.array(found.view(np.int64))

    return of(F.coalesce(text.cast("string"), F.lit("")))


class Forest:
    """BK-trees over ``values``, one for each number in ``shard``, built level by level."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        shards, first = np.unique(shard, return_index=True)
        self.shards, self.roots = shards, first
        active = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        above = first[np.searchsorted(shards, shard[active])]
        parents, edges, nodes = [], [], []
        while len(active):
            distance = np.bitwise_count(values[active] ^ values[above]).astype(np.int64)
            _, lead, group = np.unique(above * 128 + distance, return_index=True, return_inverse=True)
            parents.append(above[lead])
            edges.append(distance[lead])
            nodes.append(active[lead])
            rest = np.ones(len(active), dtype=bool)
            rest[lead] = False
            above, active = active[lead][group][rest], active[rest]
        key = (np.concatenate(parents) * 128 + np.concatenate(edges)) if parents else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.keys, self.children = key[order], (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def near(self, shard: np.ndarray, values: np.ndarray, radius: int):
        """Yields arrays of (query, node) within ``radius`` bits; queries whose shard has no tree find nothing."""
        spot = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        query = np.flatnonzero(self.shards[spot] == shard) if len(self.shards) else np.zeros(0, np.int64)
        todo = [(query, self.roots[spot[query]])] if len(query) else []
        while todo:
            query, node = todo.pop()
            if len(query) > FRONT:
                todo += [(query[i : i + FRONT], node[i : i + FRONT]) for i in range(0, len(query), FRONT)]
                continue
            distance = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 128 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * 128 + np.minimum(distance + radius, 127), side="right")
            width = high - low
            if width.any():
                todo.append((np.repeat(query, width), self.children[ranges(low, width)]))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the groups of ``a[i]`` and ``b[i]`` one label, the smallest; ``label`` points to itself at roots."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _choices(classes: int, radius: int) -> tuple[int, int]:
    """Slices, and how many of them must agree."""
    for agree in range(1, 6):
        bands = radius + agree
        if classes >> (64 * agree // bands) <= SHARD:
            break
    return bands, agree


def _masks(bands: int, agree: int) -> list[int]:
    edges = [64 * i // bands for i in range(bands + 1)]
    slices = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    masks = [sum(c) for c in itertools.combinations(slices, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u > v`` that join all nodes whose fingerprints are within ``radius`` bits.

    ``classes``: a stored table of ``node`` and ``fp``, each fingerprint once.
    """
    total = classes.count()
    masks = _masks(*_choices(total, radius))
    shards = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = classes.select("node", "fp", F.explode(shards).alias("s")).select("node", "fp", "s.choice", "s.key")
    blocks = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    tasks = max(1, math.ceil(total * len(masks) / TASK_ROWS))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(blocks.select("choice", "key", "blocks"), ["choice", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node", "fp",
            F.xxhash64("choice", "key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"),
            (F.col("own") <= F.col("other")).alias("tree"),
            (F.col("own") >= F.col("other")).alias("query"),
        )
        .withColumn("task", F.pmod(F.col("shard"), F.lit(tasks)))
    )

    def join(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        fp = rows.column("fp").to_numpy().view(np.uint64)
        shard = rows.column("shard").to_numpy()
        tree = np.flatnonzero(rows.column("tree").to_numpy())
        query = np.flatnonzero(rows.column("query").to_numpy())
        forest = Forest(shard[tree], fp[tree])
        # A node stands in several shards of a task; its places are one.
        ids, place = np.unique(node, return_inverse=True)
        label = np.arange(len(ids))
        for q, n in forest.near(shard[query], fp[query], radius):
            merge_labels(label, place[query[q]], place[tree[n]])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": ids[moved], "v": ids[label[moved]]})

    return dealt.groupBy("task").applyInArrow(join, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for every node of an edge the smallest node it is connected to."""
    edges, last = stored(edges.select("u", "v")), None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(low, F.col("u") == F.col("c"))
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u > v").distinct())
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits) ``, component_id`` (smallest id reachable) for every row."""
    small_batches(docs.sparkSession)
    prints = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    # A fingerprint is a node by itself, so that rows without id link those that have one.
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select(F.col("fp").alias("node"), "fp", "low"))
    # A document that stands in rows of several fingerprints joins their classes.
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).where("v < hi").select("doc_id", "v")
    bridges = prints.join(several, "doc_id").select(F.col("fp").alias("u"), "v").where("u > v").distinct()
    found = components(links(classes, radius).union(bridges))
    groups = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("group"), "low")
    lows = groups.groupBy("group").agg(F.min("low").alias("component_id"))
    final = groups.join(lows, "group").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    out = prints.join(final, "fp", "left")
    return out.select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without those that are near a document of smaller id (rows without id stay).

    Of several rows of the id that is kept the one with the smallest hash of its columns stays.
    """
    found = stored(near_duplicates(docs, id_col, text_col, shingle, radius).select("doc_id", "component_id"))
    name, mark = free_name(docs, "_gone"), free_name(docs, "_mark")
    id_of = F.col(id_col).cast("long") == F.col(name)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, id_of, "left_anti")
    twice = stored(found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(name)))
    if twice.isEmpty():
        return kept
    # Columns as text: maps and variants have no hash. Written, so that equal rows keep their numbers.
    row = F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"})
    rows = stored(kept.join(twice, id_of).withColumn(mark, F.struct(F.xxhash64(row).alias("a"), F.monotonically_increasing_id().alias("b"))))
    first = rows.groupBy(name).agg(F.min(mark).alias(mark))
    return kept.join(twice, id_of, "left_anti").unionByName(rows.join(first, [name, mark]).select(docs.columns))
