import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import HARD, hard, with_clashes

from barloom.llm import merge_replay

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def merges():
    return merge_replay.Merges(merge_replay.read_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def library(merges):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges.rank, special_tokens={})


def test_equals_the_library(merges, library):
    rnd = random.Random(6)
    texts = ["", "aaaaaaaaaaaaaaaaaaaaaaa" * 9, "ababababab" * 30, "'ll don't '", " \n\n  x  "]
    texts += ["".join(rnd.choice("aabcdeth ns\n1!.'éß") for _ in range(rnd.randint(1, 300))) for _ in range(400)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FFF), rnd.randint(32, 126)])) for _ in range(100)) for _ in range(200)]
    lexicon = merge_replay.Lexicon(merges, PATTERN)
    for at in (0, 300):  # the second shard meets words of the first
        part = texts[at : at + 300]
        got = [lexicon.ids_of(n).tolist() for n in lexicon.read(pa.array(part))]
        assert got == [library.encode_ordinary(t) for t in part]


def test_replay_with_merges_of_lower_rank_than_the_last():
    """A rank file in which a merge makes a pair of lower rank than its own; words of it are merged alone."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"xa", b"bcbc", b"cb"]
    merges = merge_replay.Merges(tokens)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcx") for _ in range(rnd.randint(1, 14))).encode() for _ in range(500)]
    ids, counts = merges.replay(words)
    at = 0
    for word, n in zip(words, counts):
        want = [merges.rank[word]] if word in merges.rank else merges.alone(word)
        assert ids[at : at + n].tolist() == want
        at += n


def test_columns_and_round_trip(spark, library):
    docs = with_clashes(hard(spark)).drop("ids")
    coded = merge_replay.decode(merge_replay.encode(docs, VOCABULARY, PATTERN), VOCABULARY)
    rows = coded.collect()
    assert len(rows) == len(HARD)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    digests = merge_replay.digests(docs, VOCABULARY, PATTERN).collect()
    for r in digests:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["_found"] == "mine"
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_no_rows(spark):
    assert merge_replay.encode(hard(spark).limit(0), VOCABULARY, PATTERN).count() == 0
    assert merge_replay.decode(spark.createDataFrame([(None,)], "ids array<int>"), VOCABULARY).first()["decoded"] is None


def test_missing_bytes_are_refused():
    with pytest.raises(ValueError):
        merge_replay.Merges([b"a", b"b"])
