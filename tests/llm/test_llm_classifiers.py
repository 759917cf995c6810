import pytest
from brute import hard, with_clashes
from pyspark.sql import functions as F

from barloom.llm import rff_quality, string_kernel_lid
from barloom.llm.common import doc_bucket, table
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_kernel_equals_sets_of_ngrams():
    find = string_kernel_lid.Presence()

    def grams(text):
        flat = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return {flat[i : i + n] for n in (1, 2, 3, 4) for i in range(len(flat) - n + 1)} - {" "}

    a, b = "Hello, big world", "hello small WORLD 12!"
    x, y = find.slots(a), find.slots(b)
    assert abs(len(x) - len(grams(a))) <= 1 and abs(len(set(x) & set(y)) - len(grams(a) & grams(b))) <= 1
    assert len(find.slots("12 !")) == 0 and len(find.slots(None)) == 0


def test_language_held_out(spark):
    got = QUERIES["op2_string_kernel"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_hard_rows(spark, docs):
    model = string_kernel_lid.fit(docs, F.lit(True), sample=50)
    got = string_kernel_lid.predict(with_clashes(hard(spark)), model).collect()
    assert len(got) == 13 and all(r["_found"] == "mine" for r in got)
    for r in got:
        assert 0 <= r["score"] <= 1
        no_letter = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == no_letter and (not no_letter or r["score"] == 0)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 7)} == {"en"}


def test_language_of_nothing(spark):
    assert string_kernel_lid.fit(hard(spark).limit(0), F.lit(True)) is None
    assert string_kernel_lid.fit(hard(spark), F.lit(False)) is None
    assert {r["lang_pred"] for r in string_kernel_lid.predict(hard(spark), None).collect()} == {"und"}
    model = string_kernel_lid.fit(hard(spark), F.lit(True))
    assert model.languages == ("de", "en", "es") and string_kernel_lid.predict(hard(spark).limit(0), model).count() == 0


def test_language_learns_from_text_alone(spark, docs):
    model = string_kernel_lid.fit(docs, doc_bucket("doc_id", 4) != 2, sample=100)
    bare = string_kernel_lid.predict(docs.select("text"), model)
    full = string_kernel_lid.predict(docs, model)
    pick = lambda df: sorted((r["lang_pred"], r["score"]) for r in df.collect())
    assert pick(bare) == pick(full)


def test_quality_held_out(spark):
    got = QUERIES["op4_rff_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    ones, zeros = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    wins = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
    assert wins / (len(ones) * len(zeros)) > 0.97


def test_quality_hard_rows(spark, docs):
    model = rff_quality.fit(docs, table(spark, SF, "labels"), F.lit(True), sample=300)
    got = rff_quality.score(with_clashes(hard(spark)), model).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["label"] for r in got} == {"mine"}
    assert rff_quality.score(hard(spark).limit(0), model).count() == 0


def test_quality_of_nothing(spark, docs):
    labels = table(spark, SF, "labels")
    assert rff_quality.fit(docs, labels, F.lit(False)) is None
    assert rff_quality.fit(docs.limit(0), labels, F.lit(True)) is None
    assert {r["score"] for r in rff_quality.score(hard(spark), None).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (7, 1), (7, 1), (10, 0)], "doc_id long, quality int")
    model = rff_quality.fit(hard(spark), odd, F.lit(True))
    assert rff_quality.score(hard(spark), model).count() == 13


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "!!! ???", "\n\n", "x" * 100_000):
        values = rff_quality.statistics(text)
        assert len(values) == len(rff_quality.STATISTICS) and all(v == v and abs(v) < 1e9 for v in values)
