"""Corpus pipeline: quality rules, language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` stores each stage's result and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from podium.llm import decontaminate, language_id, packing, quality_rules, simhash_dedup
from podium.llm.common import read_table, stored, prepare_workers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known main language."""
    prepare_workers(spark)
    return language_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    prepare_workers(spark)
    return simhash_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test passage to a telling extent."""
    prepare_workers(spark)
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    prepare_workers(spark)
    return packing.packed(docs).drop("ids")


STAGES = [
    ("quality rules", quality), ("language ID", language), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination), ("packing", pack),
]

#: Language ID, SimHash and packing have no SQL form; tests/llm holds each stage against a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
