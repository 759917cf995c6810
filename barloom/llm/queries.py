"""One query per operator, over whole tables, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bestfit_packing, conversation_repair, pitman_yor, rff_quality, string_kernel_lid
from barloom.llm.bktree_simhash import near_duplicates
from barloom.llm.common import doc_bucket, table
from barloom.llm.harmonic_packing import pack
from barloom.llm.histogram_topk import top_k
from barloom.llm.merge_replay import digests
from barloom.llm.merkle_warc import audit
from barloom.llm.permutation_index import nearest
from barloom.llm.spelling_variants import spelling_variants
from barloom.llm.window_dedup import dedup_lines

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = doc_bucket("doc_id", 4) == 2
    model = string_kernel_lid.fit(docs, ~held)
    return string_kernel_lid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines")


def op4_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = doc_bucket("doc_id", 5) == 0
    model = rff_quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return rff_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = doc_bucket("doc_id", 5) == 1
    scored = pitman_yor.score(docs, pitman_yor.fit(docs, ~held))
    return scored.withColumn("held_out", held)


def op8_bktree_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, BYTE_VOCABULARY, public_tokenizers.PATTERN).drop("text")


def op10_merkle_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with damage of every kind, made from the same pages by a rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    number = F.col("page_id")
    damaged = F.when(number % 97 == 5, F.concat(F.lit("#"), F.col("html").substr(F.lit(2), F.length("html")))).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(number % 89 != 3, F.lit(True))).withColumn("html", damaged)
    strays = pages.where(number % 83 == 7).withColumn("page_id", -number - 1)
    return audit(pages, replica.unionByName(strays))


def op11_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit_packing.pack(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.summaries(conversation_repair.prepare(rows, gone=gone))


def op13_bloom_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), damage=True)


QUERIES = {f.__name__: f for f in (op1_harmonic_packing, op2_string_kernel, op3_window_dedup, op4_rff_quality, op5_permutation_index, op6_histogram_topk, op7_pitman_yor, op8_bktree_simhash, op9_merge_replay, op10_merkle_warc, op11_bestfit_packing, op12_grammar_repair, op13_bloom_spelling)}
