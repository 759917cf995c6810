import random

import numpy as np
import pytest
from brute import fingerprint, groups, hard, with_clashes
from pyspark.sql import functions as F

from barloom.llm import bktree_simhash
from barloom.llm.common import stored, table


def test_fingerprints():
    rnd = random.Random(2)
    for n in (0, 1, 3, 4, 5, 400):
        text = " \t\n".join(rnd.choice(["Ab", "ab", "Ü", "x y", "ÄB"]) for _ in range(n))
        assert bktree_simhash.fingerprint(text.encode()) == fingerprint(text)


def test_groups_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    want = groups(prints)
    got = bktree_simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in want}


@pytest.mark.parametrize("block", [8, 2048])
@pytest.mark.parametrize("shard", [1, 64])
def test_links_of_dense_groups(spark, monkeypatch, block, shard):
    """Clouds of near fingerprints, in blocks of a shard and with more slices that must agree."""
    monkeypatch.setattr(bktree_simhash, "BLOCK", block)
    monkeypatch.setattr(bktree_simhash, "SHARD", shard)
    monkeypatch.setattr(bktree_simhash, "TASK_ROWS", 300)
    rnd = random.Random(4)
    values = set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))))
    prints = dict(enumerate(values))
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    classes = stored(spark.createDataFrame(rows, "node long, fp long"))
    found = {r["node"]: r["component"] for r in bktree_simhash.components(bktree_simhash.links(classes)).collect()}
    want = groups(prints)
    assert {i: found.get(i, i) for i in prints} == want and len(set(want.values())) < len(prints)


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 12, 400).astype(np.uint64))
    shard = rng.integers(0, 3, len(values))
    found = {(int(q), int(n)) for a, b in bktree_simhash.Forest(shard, values).near(shard, values, 2) for q, n in zip(a, b)}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= 2}
    assert found == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = bktree_simhash.components(edges).collect()
    assert len(got) == 299 and {r["component"] for r in got} == {0}
    assert bktree_simhash.components(edges.limit(0)).count() == 0


def test_hard_rows(spark):
    docs = with_clashes(hard(spark))
    got = bktree_simhash.near_duplicates(docs).collect()
    assert len(got) == 13
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by[(3, "0" * 16)] == by[(4, "0" * 16)] == by[(5, "0" * 16)] == 3
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    kept = bktree_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and 4 not in ids and ids.count(None) == 2 and 1 in ids and 3 in ids
    assert bktree_simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_in_rows_of_different_texts(spark):
    rows = [(5, "alpha beta gamma delta epsilon"), (5, "one two three four five"), (7, "alpha beta gamma delta epsilon"), (9, "one two three four five")]
    got = bktree_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {5}


def test_hot_copies(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in many rows of this table").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = {r["doc_id"]: r["component_id"] for r in bktree_simhash.near_duplicates(docs).collect()}
    assert all(got[i] == 0 for i in range(0, 2000, 3))


def test_one_row_of_a_repeated_id_is_kept(spark):
    rows = [(5, "alpha beta gamma delta epsilon")] * 3 + [(5, "one two three four five"), (7, "alpha beta gamma delta epsilon"), (8, "nothing like the others at all here")]
    kept = bktree_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert kept.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in kept.collect()) == [5, 8]


def test_rows_without_id_link_others(spark, monkeypatch):
    of = F.when(F.col("text") == "one", 0).when(F.col("text") == "mid", 15).otherwise(255).cast("long")
    monkeypatch.setattr(bktree_simhash, "fingerprint_column", lambda text, shingle: of)
    rows = [(1, "one"), (2, "two"), (None, "mid")]
    got = {r["doc_id"]: r["component_id"] for r in bktree_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, None: None}
    rows = [(1, "one"), (2, "two")]
    got = {r["doc_id"]: r["component_id"] for r in bktree_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}
