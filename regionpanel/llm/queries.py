"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (chat, decontaminate, fingerprints, html_text, licenses, minhash_hamming, mixing, resampling, simhash_vptree,
               suffix_dedup, toxicity, url_lists, whitening)
from .common import read_table


def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(read_table(spark, d, "documents")).drop("spans")


def op2_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents")).select(
        "doc_id", "source", "mix_position", "mix_slot", "mix_block", "in_mix")


def op3_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(read_table(spark, d, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash_hamming.near_duplicates(read_table(spark, d, "documents"), 2)


def op5_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


def op6_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.chained_fingerprints(read_table(spark, d, "documents"))


def op7_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    return chat.conversation_digests(read_table(spark, d, "conversations"))


def op8_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.removal_digest(read_table(spark, d, "documents"), 50)


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


def op10_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_lists.filtered_captures(read_table(spark, d, "pages"))


def op11_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash_vptree.near_duplicates(read_table(spark, d, "documents"), 3, 3)


def op12_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resample(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")).drop("n_words")


def op13_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read_table(spark, d, "embeddings"), 32)


def queries() -> dict:
    return {name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)}
