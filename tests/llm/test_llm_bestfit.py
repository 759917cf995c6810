import random
import sys

import public_tokenizers
import pytest
from brute import check_packing, hard, with_clashes
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bestfit_packing
from barloom.llm.bestfit_packing import ByteIds, best_fit, pack

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def words():
    return ByteIds(VOCABULARY)


def split(words, texts):
    flat, counts = words.encode(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def plain(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoded(tokenizer, rows, end=2):
    return {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [end] for r in rows}


def test_ids_of_every_character_beside_white_space(words, tokenizer):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    some = [c for c in every if c.isspace()] + every[:0x300] + random.Random(1).sample(every, 3000)
    texts = [t for c in some for t in (f"a{c} b", f"a {c}{c} {c}b ", f"!{c}\n{c}! ", f"{c}\t {c}.")]
    assert split(words, texts) == plain(tokenizer, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aB7!' \n\t\r\x1c\x85\xa0 日é") + ["'ll", "<|endoftext|>"]), max_size=40).map("".join))
def test_ids_of_any_text(words, tokenizer, text):
    assert split(words, [text]) == plain(tokenizer, [text])


def test_long_runs(words, tokenizer):
    texts = [c * n for c in ("a", " ", "^", "\n", "é", "7") for n in (999, 5000, 300_000)] + ["x " * 5000]
    assert words.ranks is not None and split(words, texts) == plain(tokenizer, texts)


def slow_best_fit(lengths, capacity):
    rooms = []
    for length in lengths:
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_tightest_open_sequence(case):
    capacity, lengths = case
    lengths = sorted(lengths, reverse=True)
    at, offsets, made = best_fit(lengths, capacity)
    used = [0] * made
    for length, number, offset in zip(lengths, at, offsets):
        assert used[number] == offset
        used[number] += length
    assert sorted(capacity - u for u in used) == slow_best_fit(lengths, capacity)
    assert sum(2 * u <= capacity for u in used) <= 1


@pytest.mark.parametrize("capacity", [64, 1024])
def test_every_id_once(spark, tokenizer, capacity):
    docs = hard(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = pack(with_clashes(docs), VOCABULARY, capacity=capacity).collect()
    check_packing(rows, encoded(tokenizer, docs.collect()), capacity)
    for doc in {r["doc_id"] for r in rows}:
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == capacity for r in pieces[1:]) and sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]


def test_few_sequences_in_many_buckets(spark, tokenizer, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = encoded(tokenizer, docs.collect())
    least = -(-sum(map(len, want.values())) // 1024)
    rows = pack(docs, VOCABULARY).collect()
    check_packing(rows, want, 1024)
    together = len({r["sequence_id"] for r in rows})
    assert together <= 1.02 * least + 1
    monkeypatch.setattr(bestfit_packing, "BUCKET_ROWS", 100)
    rows = pack(docs.repartition(5), VOCABULARY).collect()
    check_packing(rows, want, 1024)
    assert len({r["sequence_id"] for r in rows}) <= together + len(rows) / 100 + 3


def test_repeated_rows_and_null_ids(spark):
    rows = pack(hard(spark), VOCABULARY).collect()
    assert sum(r["start"] == 0 for r in rows) == 13
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_equal_rows_spread_over_buckets(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    sizes = pack(docs, VOCABULARY).groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) < 22_000


def test_ids_are_kept(spark, tokenizer):
    docs = hard(spark).where("doc_id > 4")
    want = encoded(tokenizer, docs.collect())
    for r in pack(docs, VOCABULARY, capacity=256).collect():
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)] == part


def test_no_rows(spark):
    assert pack(hard(spark).limit(0), VOCABULARY).count() == 0
