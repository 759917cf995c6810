"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots: the numbers of the first ``PREFIX`` of
``PIVOTS`` pivots, nearest first. In every shard an inverted file holds, for each pivot, the vectors
that have it in their prefix and at what place. A query adds up, over the files of its own pivots, how
much each vector's footrule distance (the sum of differences of places, a pivot beyond the prefix
counting as at its end) falls short of the largest one. The vectors with the smallest distances are
ranked again by their exact inner products.

Nearness is the largest inner product. Vectors get one more component that makes all of them equally
long (zero for a query), so that the order of pivots follows inner products also where lengths differ.

Every row is indexed; only the pivots are a sample. A shard gives each query the ``SHARE`` of its rows
with the smallest footrule distance (never fewer than were asked for) and all rows that tie with the last of them.
Rows are dealt out evenly, whatever their partitions and values, so shards are of one size and none is hot; a task keeps only the best ``k`` of each query over all its shards. Queries come in blocks of a
bounded size, which alone are broadcast.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components, and rows without id
take no part; shorter vectors are filled with zeros; rows with the query's id are its own row and no
candidates; equal vectors tie and the smaller id comes first; an id that stands in several rows asks once
(with its smallest vector) and can be found several times; no queries give no rows; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import stored
from barloom.llm.vectors import QUERY_BLOCK, best, clean, matrix, query_blocks

PIVOTS = 512
PREFIX = 96
#: Rows of a shard, about.
SHARD = 8192
SHARE = 0.15

INDEX = "ids binary, vectors binary, starts binary, rows binary, places binary"
FOUND = "query_id long, vec_id long, score double"


def choose_pivots(rows: DataFrame, width: int, longest: float, pivots: int = PIVOTS) -> np.ndarray:
    """Lengthened vectors of up to ``pivots`` rows that differ, from a sample of four times as many by a hash of the id."""
    order = F.xxhash64("id", F.lit("pivot"))
    pool = rows.orderBy(order, "id", "vec").limit(4 * pivots).collect()
    kept = list(dict.fromkeys(tuple(r["vec"]) for r in pool))[:pivots]
    return lengthened(np.array([list(v) + [0.0] * (width - len(v)) for v in kept], dtype=np.float64).reshape(len(kept), width), longest)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.hstack([vectors, rest[:, None]])


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    near = vectors @ pivots.T
    prefix = min(prefix, near.shape[1])
    if prefix < near.shape[1]:
        some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    else:
        some = np.broadcast_to(np.arange(prefix), near.shape)
    some = np.sort(some, axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def build_index(rows: DataFrame, pivots: np.ndarray, width: int, longest: float, prefix: int = PREFIX) -> DataFrame:
    """One row per shard: ids, vectors, and the inverted file (for pivot ``p`` the entries ``starts[p]`` to ``starts[p + 1]``)."""

    def shard(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        order = prefixes(lengthened(vectors, longest), pivots, prefix)
        by_pivot = np.argsort(order, axis=None, kind="stable")
        starts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
        arrays = (ids, vectors, starts.astype(np.int64), (by_pivot // order.shape[1]).astype(np.int32), (by_pivot % order.shape[1]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], type=pa.binary()) for a in arrays], names=["ids", "vectors", "starts", "rows", "places"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), matrix(b.column(1), width)) for b in batches if b.num_rows]
        if parts:
            yield shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    shards = max(1, -(-rows.count() // SHARD))
    return rows.repartition(shards).mapInArrow(build, INDEX)


def search_index(index: DataFrame, queries: tuple[np.ndarray, np.ndarray], pivots: np.ndarray, width: int, k: int, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """For one block of queries the best ``k`` of every task: ``query_id, vec_id, score``."""
    if prefix > 255:
        raise ValueError("a prefix has at most 255 pivots")
    norms = np.linalg.norm(queries[1], axis=1, keepdims=True)
    flat = np.hstack([queries[1] / norms, np.zeros((len(norms), 1))])
    shared = index.sparkSession.sparkContext.broadcast((*queries, prefixes(flat, pivots, prefix)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked, order = shared.value
        length = order.shape[1]
        left = np.arange(length, 0, -1, dtype=np.uint8)[:, None]
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        for batch in batches:
            for row in range(batch.num_rows):
                raw = {name: batch.column(name)[row].as_buffer() for name in ("ids", "vectors", "starts", "rows", "places")}
                ids = np.frombuffer(raw["ids"], dtype=np.int64)
                vectors = np.frombuffer(raw["vectors"]).reshape(len(ids), width)
                starts = np.frombuffer(raw["starts"], dtype=np.int64)
                rows, places = np.frombuffer(raw["rows"], dtype=np.int32), np.frombuffer(raw["places"], dtype=np.int32)
                wanted = max(k + 1, int(np.ceil(share * len(ids))))  # the query's own row may be among them
                # The files as rows of the pivots: how far before the end of its prefix a vector has the pivot, or 0.
                files = np.zeros((len(starts) - 1, len(ids)), dtype=np.uint8)
                files[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), rows] = length - places
                for q in range(len(query_ids)):
                    near = np.minimum(files[order[q]], left).sum(axis=0, dtype=np.uint16)
                    if wanted < len(ids):
                        some = np.flatnonzero(near >= np.partition(near, len(ids) - wanted)[len(ids) - wanted])
                    else:
                        some = np.arange(len(ids))
                    some = some[ids[some] != query_ids[q]]
                    found = np.concatenate([top[q][0], ids[some]])
                    # Row by row, so that equal vectors get equal scores.
                    scores = np.concatenate([top[q][1], (vectors[some] * asked[q]).sum(axis=1)])
                    first = best(scores, found, k)
                    top[q] = (found[first], scores[first])
        sizes = [len(t[0]) for t in top]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([t[0] for t in top])), pa.array(np.concatenate([t[1] for t in top]))],
                names=["query_id", "vec_id", "score"],
            )

    return index.mapInArrow(search, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of each query over all tasks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest found of every query; ``is_query`` is a condition on the column ``id``."""
    rows = clean(table, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    facts = rows.agg(F.max(F.size("vec")).alias("width"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    if facts["width"] is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, longest = facts["width"], float(np.sqrt(facts["longest"]))
    chosen = choose_pivots(rows, width, longest, pivots)
    index = stored(build_index(rows, chosen, width, longest, prefix))
    found = None
    for queries in query_blocks(rows, is_query, width, block):
        part = search_index(index, queries, chosen, width, k, prefix, share)
        found = part if found is None else found.union(part)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(found, k)
