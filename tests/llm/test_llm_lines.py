import random

import pytest
from brute import dedup_lines as brute
from brute import hard, with_clashes

from barloom.llm.window_dedup import dedup_lines


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    docs = [(i, "\n".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_spans_merge(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny\nb\nc\nd")]
    row = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id = 2").first()
    assert row["text"] == "x\ny" and row["n_lines"] == 9
    assert [tuple(s) for s in row["removed_spans"]] == [(1, 5), (6, 9)]


def test_hard_rows(spark):
    docs = with_clashes(hard(spark))
    got = dedup_lines(docs).collect()
    assert len(got) == docs.count()
    assert all(r["label"] == "mine" and r["_row"] == "mine" for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["removed_lines"] == 0
    assert [r["text"] for r in by[2]] == ["", ""] and by[2][0]["n_lines"] == 4
    assert by[3][0]["text"] is None and by[3][0]["n_lines"] == 0
    assert by[8][0]["text"] == "a\na\na"  # a run of equal lines: what overlaps the first window stays
    assert {r["text"] for r in by[None]} == {None, "Ein Text ohne Nummer, aber mit Worten."}


def test_no_rows(spark):
    assert dedup_lines(hard(spark).limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(hard(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_hot_passage(spark):
    docs = [(i, f"{i}\nsame\npassage\nhere\n{-i}") for i in range(400)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r["removed_lines"] for r in got) == 3 * 399
