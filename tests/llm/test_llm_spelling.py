import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import hard, lower, with_clashes
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barloom.llm.spelling_variants import Layout, Neighbours, _hash, _matrix, _place, spelling_variants, variants


def slow_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def result(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_hard_rows(spark):
    docs = hard(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = spelling_variants(with_clashes(docs), damage=True)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert result(got) == slow_variants(slow_words(rows))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = slow_variants(slow_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert sum(f is not None for _, f, *_ in want) > 5
    assert result(spelling_variants(docs, damage=True)) == want


@pytest.mark.parametrize("limit", [32 << 20, 64])
def test_chains_ties_and_many_groups_of_filters(spark, limit):
    words = {"kitchen": 1_000_000, "kitchan": 99_999, "kitcpan": 9_999, "kitcpanz": 999, "kitcpanzz": 99, "kitcpaanzz": 9, "kitchens": 1_000_000, "zitchen": 2}
    words |= {f"kitchen{chr(c)}": 3 for c in range(0xE0, 0xFF)} | {f"{chr(c)}itchen": 5 for c in range(0x61, 0x6A)}
    words |= {"aabbccd": 2, "aabbcd": 2, "abbccdÿ": 40, "aabbccdd": 40, "÷×abcde": 2, "mmmmmmm": 3, "mmmmmmmm": 30, "mmmmmmmmm": 300}
    rows = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long").repartition(3)
    assert result(variants(rows, limit=limit)) == slow_variants(words)


def test_layout_bounds_what_is_broadcast():
    layout = Layout({7: 1_000_000, 8: 50, 9: 400_000, 10: 1}, limit=1 << 20)
    for some in layout.passes:
        assert sum(8 * layout.blocks[n] for n, _ in some) <= 1 << 20
    assert sorted(x for p in layout.passes for x in p) == [(n, g) for n in (7, 8, 9, 10) for g in range(layout.groups[n])]
    assert sum(8 * layout.blocks[7] for n, _ in sum(layout.passes, []) if n == 7) * 8 >= 20 * 1_000_000


LETTER = st.sampled_from("abcéÿ")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(LETTER, min_size=2, max_size=6), min_size=1, max_size=60))
def test_no_neighbour_is_missed(words):
    words = sorted(words)
    layout = Layout(Counter(map(len, words)))
    filters = {(n, 0): np.zeros(layout.blocks[n], np.uint64) for n in layout.blocks}
    for w in words:
        _, block, bits = _place(_hash(_matrix([w])), layout.blocks[len(w)], 1)
        filters[len(w), 0][block] |= bits
    left, right = Neighbours(filters, layout, sorted({ord(c) for w in words for c in w})).of(words)
    found = [frozenset(p) for p in zip(left, right) if p[1] in words]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_no_rows_and_one_hot_word(spark):
    assert spelling_variants(hard(spark).limit(0)).count() == 0
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("neighbour neighbor " * 20).alias("text"))
    want = slow_variants(slow_words([(i, "neighbour neighbor " * 20) for i in range(2000)]))
    assert result(spelling_variants(docs, damage=True)) == want
