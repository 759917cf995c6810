"""Slow, plain versions of what the operators compute, and rows that are hard on them."""

import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG = "Once upon a time there was a very long text, and it went on. " * 4000
HARD = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt runs.\nIt hides.\nIt sleeps.", "en", "a", 60),
    (2, "The quick brown fox jumps over the lazy dog.\nIt runs.\nIt hides.\nIt sleeps.", "en", "a", 60),
    (2, "The quick brown fox jumps over the lazy dog.\nIt runs.\nIt hides.\nIt sleeps.", "en", "a", 60),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, "   \t\n\n  ", "de", "b", 5),
    (6, "12345 !!! ???", "de", "b", 5),
    (None, "Ein Text ohne Nummer, aber mit Worten.", None, None, None),
    (None, None, None, None, None),
    (7, LONG, "en", "c", len(LONG)),
    (8, "a\na\na\na\na\na\na", "en", "c", 13),
    (9, "日本語 テキスト 🙂 ñandú́ \x00 \x1c", "es", "c", 9),
    (10, "don't. it's, 'll! A.B.C... İstanbul", "en", "c", 9),
]

CLASHING = ["id", "row", "w", "score", "lang_pred", "predicted", "length", "n", "_found", "_row", "_gone", "n_lines", "ids", "component_id", "label", "x"]


def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


def with_clashes(df):
    """``df`` with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def fingerprint(text, shingle=4):
    found = words(text)
    if not found:
        return 0
    shingles = [" ".join(found)] if len(found) < shingle else [" ".join(found[i : i + shingle]) for i in range(len(found) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, radius=4):
    """Smallest id reachable, for a dict of fingerprints by id."""
    ids = sorted(prints)
    lead = {i: i for i in ids}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {i: find(i) for i in ids}


def dedup_lines(docs, window=3):
    """``(id, text)`` pairs of distinct ids -> texts without later windows, and lines removed."""
    first, gone = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        lines = [] if text is None else text.split("\n")
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            home = first.setdefault(key, (i, p))
            if home != (i, p) and not (home[0] == i and p < home[1] + window):
                gone.setdefault(i, set()).update(range(p, p + window))
    out = {}
    for i, text in docs:
        cut = gone.get(i, set())
        out[i] = (text, 0) if not cut else ("\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut), len(cut))
    return out


def crc_of_ids(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_packing(rows, encoded, capacity=4096):
    """``rows`` place every id of ``encoded`` (ids by document) exactly once, without gaps; returns the padded share."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == encoded.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(encoded[doc])
            at += r["length"]
            assert r["ids_crc32"] == crc_of_ids(encoded[doc][r["start"] : at])
        assert at == len(encoded[doc])
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        used += at
    return 1 - used / (capacity * len(by_sequence))
