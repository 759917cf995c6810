import random
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import check_packing, hard, with_clashes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import harmonic_packing
from barloom.llm.harmonic_packing import Cutter, WordIds, assemble, class_lengths, pack

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def encoded(tokenizer, rows, end=2):
    return {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [end] for r in rows}


def test_marks_after_every_letter_and_digit(tokenizer):
    words = WordIds(VOCABULARY)
    every = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalnum()]
    apart = [c for c in every if len(c.lower()) > 1 or not unicodedata.is_normalized("NFC", c)]
    assert len(apart) > 60 and "\u0130" in apart
    some = apart + random.Random(3).sample(every, 4000)
    texts = [f"{c}{m} a{c}{m}{m} b" for c in some for m in ("}", ".", "!?")]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    flat, counts = words.encode(pa.array(texts))
    at = np.cumsum(counts)
    assert [x.tolist() for x in np.split(flat, at[:-1])] == want


def test_equal_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(harmonic_packing, "BUCKET_ROWS", 5000)
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    packed = pack(docs, VOCABULARY)
    assert packed.select(F.count("*"), F.count_distinct("sequence_id", "offset")).first() == (100_000, 100_000)
    assert packed.agg(F.max("sequence_id")).first()[0] == -(-100_000 // 4096) - 1
    plan = packed._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(_task" in plan


def test_cuts_are_class_lengths():
    for capacity in (64, 100, 4096):
        lengths, cutter = set(class_lengths(capacity)), Cutter(capacity)
        for n in (1, 2, 63, 64, 65, 1000, 4095, 4096, 4097, 12345):
            cuts = cutter.cut(n)
            assert sum(cuts) == n and set(cuts) <= lengths
    assert all(4096 % x < 64 for x in class_lengths(4096))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_every_id_once(spark, tokenizer, capacity):
    docs = hard(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = pack(with_clashes(docs), VOCABULARY, capacity=capacity).collect()
    check_packing(rows, encoded(tokenizer, docs.collect()), capacity)


def test_little_padding(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pack(docs, VOCABULARY).collect()
    assert check_packing(rows, encoded(tokenizer, docs.collect())) < 0.03


def test_repeated_rows_and_null_ids(spark):
    rows = pack(hard(spark), VOCABULARY).collect()
    assert sum(r["start"] == 0 for r in rows) == 13
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_assembled_sequences(spark, tokenizer):
    docs = hard(spark).where("doc_id > 4")
    packed = pack(docs, VOCABULARY, capacity=256)
    ids = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4") for r in assemble(packed).collect()}
    want = encoded(tokenizer, docs.collect())
    for r in packed.collect():
        part = ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert part.tolist() == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_no_rows(spark):
    assert pack(hard(spark).limit(0), VOCABULARY).count() == 0


def test_hot_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    rows = pack(docs, VOCABULARY).collect()
    assert len(rows) == 3000 and len({r["sequence_id"] for r in rows}) == 3
