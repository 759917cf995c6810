import collections
import math
import zlib

import numpy as np
import pytest
from brute import hard, with_clashes, words
from pyspark.sql import functions as F

from barloom.llm import pitman_yor
from barloom.llm.common import doc_bucket, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    docs = table(spark, SF, "documents")
    model = pitman_yor.fit(docs, doc_bucket("doc_id", 5) != 1)
    return docs.collect(), model, {r["doc_id"]: r for r in pitman_yor.score(docs, model).collect()}


def test_counts_and_base(scored):
    docs, model, got = scored
    tokens = {r["doc_id"]: words(r["text"]) + [None] for r in docs}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.distinct) == (n, v) and len(got) == len(docs)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(counts[w] > 0 for w in t)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(10 ** (-got[i]["score"] / len(t)), rel=1e-9)


def test_better_than_base_on_held_out(scored):
    _, _, got = scored
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up_to_one(spark, scored):
    _, model, _ = scored
    rows = model.words.collect()
    for context in (0, 17, 4000):
        total = float(np.mean(model.weights[:, context] * model.unknown))
        for r in rows:
            seen = dict(zip(r["gs"], r["ps"]))
            total += seen.get(context, float(np.mean(model.weights[:, context] * np.array(r["p1"]))))
        assert total == pytest.approx(1.0, abs=1e-4)


def test_frequent_and_joined_words_score_alike(spark, scored):
    _, model, got = scored
    docs = table(spark, SF, "documents")
    for r in pitman_yor.score(docs, model, frequent=0).collect():
        assert r["score"] == pytest.approx(got[r["doc_id"]]["score"], rel=1e-6)
        assert r["n_known"] == got[r["doc_id"]]["n_known"] and r["base_score"] == pytest.approx(got[r["doc_id"]]["base_score"], rel=1e-9)


def test_seating_follows_the_rule():
    rng = np.random.default_rng(5)
    n, new, discount = 200, 3.0, 0.4
    many = pitman_yor.seat(np.full(4000, n), np.full(4000, new), discount, rng)
    slow = []
    for _ in range(2000):
        tables = 1
        for seated in range(1, n):
            tables += rng.random() < new / (new + seated - discount * tables)
        slow.append(tables)
    assert many.min() >= 1 and many.max() <= n
    assert many.mean() == pytest.approx(np.mean(slow), rel=0.03) and many.std() == pytest.approx(np.std(slow), rel=0.1)
    assert (pitman_yor.seat(np.ones(5, dtype=int), np.full(5, 9.0), 0.5, rng) == 1).all()


def test_hard_rows(spark):
    docs = with_clashes(hard(spark))
    model = pitman_yor.fit(docs, F.lit(True))
    got = pitman_yor.score(docs, model).collect()
    assert len(got) == 13 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def test_nothing_learned(spark):
    model = pitman_yor.fit(hard(spark), F.lit(False))
    got = pitman_yor.score(hard(spark), model).collect()
    assert len(got) == 13 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in got)
    assert pitman_yor.score(hard(spark).limit(0), model).count() == 0


def test_the_whole_word_before_counts(spark):
    """``bathe``, ``the`` and ``she`` end alike; what follows each of them is its own."""
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate([("bathe", "north"), ("the", "south"), ("she", "west")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "bathe north"), (1, "bathe south"), (2, "she west"), (3, "she north")], "doc_id long, text string")
    model = pitman_yor.fit(docs, F.lit(True))
    for few in ({}, {"frequent": 0}, {"known_pairs": 0}):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score(asked, model, **few).collect()}
        assert got[0] > got[1] + 0.5 and got[2] > got[3] + 0.5
    assert model.contexts.count() == 7  # six words and the start


def test_probabilities_after_a_word_add_up_to_one(spark, scored):
    docs, model, _ = scored
    rows = model.words.collect()
    for r in model.contexts.orderBy(F.desc("c"), "h").limit(3).collect() + model.contexts.orderBy("c", "h").limit(2).collect():
        # Of the ending, the words' probabilities add up to one; so must the rest.
        seen = sum(p["a"] for p in model.pairs.where(F.col("h") == r["h"]).collect())
        assert seen * r["x"] + r["y"] == pytest.approx(1.0, abs=1e-5)
    assert len(rows) == model.distinct
    pairs = {(a, b) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 != 1 for t in [words(d["text"]) + [None]] for a, b in zip([None] + t, t)}
    assert model.pairs.count() == len(pairs)


def test_many_blocks(spark, scored, monkeypatch):
    """Words dealt to many blocks, and slices of few texts: the same counts, whole distributions, and nearly the same scores."""
    docs, one, got = scored
    monkeypatch.setattr(pitman_yor, "BLOCK", 1 << 15)
    monkeypatch.setattr(pitman_yor, "SLICE", 1 << 15)
    frame = table(spark, SF, "documents")
    model = pitman_yor.fit(frame, doc_bucket("doc_id", 5) != 1)
    assert model.blocks > 5 and (model.train_tokens, model.distinct) == (one.train_tokens, one.distinct)
    assert {(r["h"], r["w"]): r["n"] for r in model.pairs.collect()} == {(r["h"], r["w"]): r["n"] for r in one.pairs.collect()}
    seen = collections.Counter()
    for r in model.pairs.collect():
        seen[r["h"]] += r["a"]
    for r in model.contexts.collect():
        assert seen[r["h"]] * r["x"] + r["y"] == pytest.approx(1.0, abs=1e-5)
    for few in ({}, {"frequent": 20}):
        again = pitman_yor.score(frame, model, **few).collect()
        assert len(again) == len(docs)
        for r in again:
            old = got[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"]) == (old["n_tokens"], old["n_known"]) and r["base_score"] == pytest.approx(old["base_score"], rel=1e-9)
        assert sum(r["score"] for r in again) == pytest.approx(sum(r["score"] for r in got.values()), rel=2e-3)


def test_writes_fewer_rows_than_pairs(spark, monkeypatch):
    """Neither the sweeps nor the scores write a row a pair: the disk they took was several times the input."""
    rows = []

    def counted(df, keep=pitman_yor.stored):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(pitman_yor, "stored", counted)
    docs = table(spark, SF, "documents")
    model = pitman_yor.fit(docs, F.lit(True))
    assert pitman_yor.score(docs, model).count() == docs.count()
    assert sum(rows) < model.pairs.count()
