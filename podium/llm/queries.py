"""The registered queries op1_ to op13_ and their DuckDB twins.

Each takes (spark, sf_dir), applies one operator to its whole table with production
parameters and derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import oracle, quality_classifier, toxicity
from podium.llm.common import fold_of, read_table, stored, prepare_workers
from podium.llm.decontaminate import judged
from podium.llm.html_extract import extract, infer_wrappers
from podium.llm.language_id import identify, train
from podium.llm.packing import packed
from podium.llm.pii import KINDS, listed, personal_data
from podium.llm.preference_format import preference_segments, with_echo_answer
from podium.llm.prefix_trie import conversation_trie
from podium.llm.quality_rules import judge
from podium.llm.run_detection import detect_runs, strongest
from podium.llm.simhash_dedup import components, fingerprints
from podium.llm.token_counts import prefix_counts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rule and host-aware verdict of every document."""
    return judge(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _judged(toxicity.score(docs, toxicity.train(docs, labels)), 0.5)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from trusted positives and unlabelled documents."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    network, _ = quality_classifier.train(docs, labels)
    return _judged(quality_classifier.score(docs, network), 0.3)


def _judged(scores: DataFrame, limit: float) -> DataFrame:
    """The contract's held_out and predicted beside a score."""
    return scores.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= limit).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits and the contamination verdict of every document."""
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from a model that has not seen the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs)).select("doc_id", "lang_pred", "score")
    return found.withColumn("held_out", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return components(fingerprints(read_table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from its prefix table."""
    counts = prefix_counts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens")
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, related documents together."""
    return packed(read_table(spark, sf_dir, "documents")).drop("ids")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by its host's wrapper."""
    pages = read_table(spark, sf_dir, "pages")
    texts = extract(pages, stored(infer_wrappers(pages), "wrappers"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion segments of every conversation against an echo answer."""
    return preference_segments(*with_echo_answer(read_table(spark, sf_dir, "conversations")))


def op11_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document with its planted tail, and the text without the repetitions."""
    found = detect_runs(read_table(spark, sf_dir, "documents"), rewrite=True)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt on the first of their five."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"), rebuild=True)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and places of the fixed forms, and all spans."""
    found = personal_data(read_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


_ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_quality_rules, op2_toxicity, op3_decontamination, op4_language_id, op5_simhash_dedup, op6_token_counts,
    op7_quality_classifier, op8_packing, op9_html_extraction, op10_preference_format,
    op11_run_detection, op12_prefix_trie, op13_pii,
]


def _bound(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare_workers(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {fn.__name__: _bound(fn) for fn in _ALL}
ORACLES = {name: sql for name, sql in oracle.ORACLE.items() if name in QUERIES}
