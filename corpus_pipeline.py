"""A corpus cleaned and packed in stages, each by an operator of barloom.llm."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from barloom.llm import bktree_simhash, harmonic_packing, rff_quality, string_kernel_lid, window_dedup  # noqa: E402
from barloom.llm.common import doc_bucket, free_name, stored, table  # noqa: E402
from barloom.llm.queries import WORD_VOCABULARY  # noqa: E402

#: A language that is less sure than this is no language.
LEAST_SURE = 0.3
#: The columns that stages read.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def with_own_columns(stage):
    """A stage that leaves columns beside those of documents as they are, whatever names its operator gives its results."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        taken = {c: free_name(docs, f"_own{i}") for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = stage(spark, docs.withColumnsRenamed(taken), sf_dir)
        return out.withColumnsRenamed({hidden: c for c, hidden in taken.items()}).select(docs.columns)

    run.__doc__ = stage.__doc__
    return run


@with_own_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no letter, or n-grams that no learned language has."""
    model = string_kernel_lid.fit(docs, doc_bucket("doc_id", 4) != 2)
    known = free_name(docs, "_known")
    found = string_kernel_lid.predict(docs, model, known_col=known)
    sure = (F.col("score") >= LEAST_SURE) & (F.col(known) >= (model.least if model else 0.0))
    return found.where((F.col("lang_pred") != string_kernel_lid.UNKNOWN) & sure).select(docs.columns)


@with_own_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality."""
    model = rff_quality.fit(docs, table(spark, sf_dir, "labels"), doc_bucket("doc_id", 5) != 0)
    return rff_quality.score(docs, model).where("predicted = 1").select(docs.columns)


@with_own_columns
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand earlier in the corpus; ``n_chars`` follows the text."""
    return window_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@with_own_columns
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies."""
    return bktree_simhash.keep_one(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    packed = harmonic_packing.pack(docs, WORD_VOCABULARY, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("packing", packing),
]

#: Two stages are trained models and one a tokenizer: tests compare with a slow version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
