"""Corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; all but the last return the columns of ``documents``, the
last adds each row's place in the mix.

Nulls, empty and very long texts, repeated rows and empty tables are handled
as the operators' docstrings say: a null or empty text is no duplicate, holds
no passage and no benchmark item and is scored like any other; rows with a
null id are kept by every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionpanel.llm import decontaminate, minhash_hamming, mixing, suffix_dedup, toxicity
from regionpanel.llm.common import read_table, staged

#: shortest repeated passage that goes, in bytes: more than 50 words have at least 100
PASSAGE_BYTES = 100
#: near-duplicates: words of a shingle, similarity in hundredths
SHINGLE_WORDS, SIMILARITY = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_hamming.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY, 100)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: trees, components and schedules are beyond SQL: tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
