import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import permutation_index
from barloom.llm.histogram_topk import top_k
from barloom.llm.permutation_index import nearest
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, id string, vec string"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float((i * 7 + j * 3) % 5 - 2) for j in range(6)], "x", "y") for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5], "x", "y") for i in range(300, 900)]  # one very common vector
    rows += [(1000, None, "x", "y"), (1100, [nan] * 6, "x", "y"), (1200, [inf] + [0.0] * 5, "x", "y"), (1300, [None] * 6, "x", "y")]
    rows += [(1400, [0.0] * 6, "x", "y"), (1500, [], "x", "y"), (1600, [2.0, 1.0], "x", "y"), (None, [1.0] * 6, "x", "y")]
    return rows


def brute(rows, every, k, scale=None):
    kept = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.zeros(6)
        x[: len(v)] = np.array(v, dtype=np.float32)
        if scale is None and not x.any():
            continue
        kept.append((i, np.floor(scale * x).astype(np.int64) if scale else x))
    out = {}
    for q, v in kept:
        if q % every == 0:
            found = sorted((-(v * x).sum(), i) for i, x in kept if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        rows = out.setdefault(r["query_id"], [])
        rows.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(rows)
    return out


@pytest.mark.parametrize("k", [3, 10])
def test_top_k_equals_brute_force(spark, k):
    rows = odd_rows()
    got = collected(top_k(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("id") % 50 == 0, k=k))
    assert got == brute(rows, 50, k, 1024)


def test_top_k_in_several_blocks(spark):
    rows = odd_rows()
    got = collected(top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, k=4, block=5))
    assert got == brute(rows, 50, 4, 1024)


def test_top_k_of_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], "x", "y") for i in range(2000)]
    got = collected(top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("id") % 100 == 0, k=10))
    assert got == brute(rows, 100, 10, 1024)


def test_top_k_refuses_what_64_bits_do_not_hold(spark):
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(0, [3e38] * 6, "x", "y")], SCHEMA), F.col("id") % 2 == 0)


def test_nearest_with_ties_equals_brute_force(spark):
    rows = odd_rows()
    got = collected(nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 50 == 0, k=5, share=1.0))
    assert got == brute(rows, 50, 5)


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = collected(QUERIES["op5_permutation_index"](spark, SF))
    hits = 0
    for q, near in found.items():
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len({i for i, _ in near} & set(ids[np.lexsort((ids, -scores))[:20]]))
        assert len(near) == 20 and all(abs(scores[ids == i][0] - s) < 1e-12 for i, s in near)
    assert len(found) == (ids % 20 == 0).sum() and hits / (20 * len(found)) >= 0.9


@pytest.mark.parametrize("partitions, shard", [(1, 8192), (64, 8192), (4, 256)])
def test_recall_does_not_come_from_small_shards(spark, monkeypatch, partitions, shard):
    monkeypatch.setattr(permutation_index, "SHARD", shard)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(partitions)
    rows = table.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = collected(nearest(table, F.col("id") % 20 == 0))
    hits = 0
    for q, near in found.items():
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len({i for i, _ in near} & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert len(found) == 100 and hits / 2000 >= 0.95


def test_nearest_recall_with_lengths_and_few_candidates(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(12_000, 16)) * rng.uniform(0.5, 2, size=(12_000, 1))).astype(np.float32)
    rows = [(i, [float(x) for x in v], "x", "y") for i, v in enumerate(vectors)]
    found = collected(nearest(spark.createDataFrame(rows, SCHEMA).repartition(2), F.col("id") % 400 == 0, k=20))
    flat, hits = vectors.astype(np.float64), 0
    for q, near in found.items():
        scores = flat @ flat[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in near} & set(np.argsort(-scores)[:20]))
    assert len(found) == 30 and hits / 600 >= 0.9


@pytest.mark.parametrize("search", [top_k, nearest])
def test_nothing_to_search(spark, search):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    for table in (rows.limit(0), rows.where("vec_id IS NULL"), rows.where("vec_id = 7")):
        assert search(table, F.col("id") % 50 == 0).count() == 0
    lone = rows.where("vec_id = 50")
    assert search(lone, F.col("id") % 50 == 0).count() == 0
