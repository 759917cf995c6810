"""What the two vector searches share: clean rows, matrices, bounded blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Queries that one pass over the vectors answers. Only they are broadcast.
QUERY_BLOCK = 8192


def clean(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` (array of double) of the rows that can take part: an id, and finite components only."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def query_blocks(rows: DataFrame, is_query: Column, width: int, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of at most about ``size`` queries each; an id that stands in several rows asks with its smallest vector."""
    queries = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    blocks = max(1, math.ceil(rows.where(is_query).select("id").distinct().count() / size))
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        if part:
            part.sort(key=lambda r: r["id"])
            filled = np.array([list(r["vec"]) + [0.0] * (width - len(r["vec"])) for r in part], dtype=np.float64).reshape(len(part), width)
            yield np.array([r["id"] for r in part], dtype=np.int64), filled


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
