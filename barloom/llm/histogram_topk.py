"""Exact top-k search by distributed histogram selection.

Components become integers, scores are integer inner products, so nothing depends on the order of sums.
All scores of a block of queries are counted in a histogram per query; Spark adds the histograms of all
tasks. The bin that holds a query's kth largest score becomes the range of its next histogram, until the
bin is one score wide or so few rows lie above its lower end that they can be ranked directly. A last
pass keeps the rows from that score up, at most ``k`` of each query in a task (largest score, then
smallest id), and a window over these gives the result. Scores are made anew in every pass; they are
matrix products, cheaper than storing them.

Queries come in blocks of a bounded size; only a block and its bounds (a few numbers per query) are sent
to the tasks or gathered. Ties of any number cost at most ``k`` rows a task.

Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without id take
no part; a zero or empty vector takes part with score 0; shorter vectors are filled with zeros; rows with
the query's id are its own row and no candidates; an id that stands in several rows asks once (with its
smallest vector) and can be found several times; products beyond 64 bits raise ValueError; no queries
give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.vectors import QUERY_BLOCK, best, clean, matrix, query_blocks

SCALE = 1024
BINS = 256
#: Rows above the bound of a query, in multiples of k, that are ranked without another histogram.
FEW = 8
#: Scores that stand in memory at once.
TILE = 2_000_000

RESULT = "query_id long, rank int, vec_id long, score long"


def _scores(rows: np.ndarray, queries: np.ndarray, limit: int) -> np.ndarray:
    """Integer products, queries by rows; doubles hold them exactly below 2^53."""
    if limit < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def _tiles(batches: Iterator[pa.RecordBatch], width: int, scale: float, query_ids: np.ndarray, queries: np.ndarray, limit: int):
    """Yields query range, ids, scores, and which rows are not the query's own."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        rows = np.floor(scale * matrix(batch.column(1), width)).astype(np.int64)
        step = max(1, TILE // max(1, len(ids)))
        for at in range(0, len(query_ids), step):
            part = slice(at, min(at + step, len(query_ids)))
            yield part, ids, _scores(rows, queries[part], limit), ids[None, :] != query_ids[part, None]


def _select(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, width: int, scale: float, limit: int, k: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    block = context.broadcast((query_ids, queries))
    n = len(query_ids)
    low, step = np.full(n, -limit, dtype=np.int64), np.full(n, -(-(2 * limit + 1) // BINS), dtype=np.int64)
    above = np.zeros(n, dtype=np.int64)  # rows that score more than the present range
    open_ = np.ones(n, dtype=bool)
    while open_.any():
        bounds = context.broadcast((low, step, open_))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, step, open_ = bounds.value
            total = np.zeros((n, BINS), dtype=np.int64)
            for part, _, scores, other in _tiles(batches, width, scale, *block.value, limit):
                bins = (scores - low[part, None]) // step[part, None]
                counted = other & (bins >= 0) & (bins < BINS) & open_[part, None]
                flat = (np.arange(part.stop - part.start)[:, None] * BINS + bins)[counted]
                total[part] += np.bincount(flat, minlength=(part.stop - part.start) * BINS).reshape(-1, BINS)
            query, bin_ = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bin_), pa.array(total[query, bin_])], names=["q", "b", "n"])

        histogram = rows.mapInArrow(count, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        more = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("b")))
        every = F.sum("n").over(Window.partitionBy("q"))
        reached = histogram.withColumn("more", more).withColumn("every", every)
        # Of each query the first bin, from the top, at which k rows are reached (rows above the range count);
        # its lowest bin if there are fewer.
        wanted = rows.sparkSession.createDataFrame([(int(q), int(k - above[q])) for q in np.flatnonzero(open_)], "q long, need long")
        hit = reached.join(F.broadcast(wanted), "q").where((F.col("more") - F.col("n") < F.col("need")) & ((F.col("more") >= F.col("need")) | (F.col("more") == F.col("every"))))
        seen = np.zeros(n, dtype=bool)
        for r in hit.select("q", "b", "n", "more").collect():  # one row per query of the block
            q = r["q"]
            seen[q] = True
            low[q] += r["b"] * step[q]
            above[q] += r["more"] - r["n"]
            if step[q] == 1 or above[q] + r["n"] <= FEW * k:
                open_[q] = False
            else:
                step[q] = -(-step[q] // BINS)
        open_ &= seen  # without a candidate there is nothing to refine
        low = low.copy()
    final = context.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, query_ids = final.value, block.value[0]
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for part, ids, scores, other in _tiles(batches, width, scale, *block.value, limit):
            query, row = np.nonzero((scores >= least[part, None]) & other)
            values = scores[query, row]
            cuts = np.searchsorted(query, np.arange(part.stop - part.start + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                here = slice(cuts[i], cuts[i + 1])
                found = np.concatenate([top[part.start + i][0], ids[row[here]]])
                score = np.concatenate([top[part.start + i][1], values[here]])
                first = best(score, found, k)
                top[part.start + i] = (found[first], score[first])
        sizes = [len(t[0]) for t in top]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([t[0] for t in top])), pa.array(np.concatenate([t[1] for t in top]))],
                names=["query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(keep, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: float = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query; ``is_query`` is a condition on the column ``id``."""
    rows = clean(table, id_col, vec_col)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.floor(x * F.lit(float(scale))).cast("double") * F.floor(x * F.lit(float(scale))).cast("double"))
    facts = rows.agg(F.max(F.size("vec")).alias("width"), F.max(square).alias("square")).first()
    empty = table.sparkSession.createDataFrame([], RESULT)
    if facts["width"] is None:
        return empty
    if facts["square"] >= 2.0**62:
        raise ValueError("integer products of these vectors need more than 64 bits")
    limit = int(facts["square"] * (1 + 1e-9)) + 1
    found = None
    for query_ids, vectors in query_blocks(rows, is_query, facts["width"], block):
        queries = np.floor(scale * vectors).astype(np.int64)
        part = _select(rows, query_ids, queries, facts["width"], scale, limit, k)
        found = part if found is None else found.union(part)
    if found is None:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
