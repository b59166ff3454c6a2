"""Quality rules per document and per host, with DataFrame functions only.

Base counts (``base_counts``) and the rules on them (``RULES``) look at one document.
``host_rates`` adds up failures per host (the ``source`` column), and shrinks each
host's failure rate with a beta prior fitted to all hosts by moments: a host with few
documents stays close to the mean of the hosts, a large one keeps its own rate.
``judge`` joins the host's verdict back: documents of a host whose shrunk rate lies ``host_deviations`` standard
deviations of the hosts' rates above their mean, or at ``host_limit``, must pass the strict rules, all
others the usual ones. A document
that breaks no rule is kept whatever its host looks like.

Defined results: a null text counts as empty; it has no words and fails the base rule. A null
host is a host of its own. Repeated rows are judged each by itself and each counts for
its host. An empty table gives an empty result. Columns other than ``doc_id``, ``text``
and ``source`` are neither read nor returned by ``judge``; ``keep_good`` returns its
input's columns unchanged, whatever their names.

Shuffle: one sum per host and task. The host table joins back on the host; AQE
broadcasts it or splits a hot host's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import free_name, stored

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Rule limits. The ``strict_`` ones hold for documents of hosts with a bad verdict."""

    min_words: int = 50
    repeat_percent: int = 50
    symbols_per_100_words: int = 30
    strict_symbols_per_100_words: int = 15
    dup_line_percent: int = 50
    strict_dup_line_percent: int = 30
    min_word_chars_x10: int = 20
    max_word_chars_x10: int = 150
    host_limit: float = 0.5
    host_deviations: float = 1.0


def _without(text: Column, chars: str) -> Column:
    """The text without any of ``chars``."""
    return F.translate(text, chars, "")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` to ``df``: a struct of n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words, counted over the whole text.

    A three-word window that occurs twice or more marks its words as repeated. The windows of a text
    are sorted with their positions, so equal ones stand side by side; a marked window
    at position p adds its words that the next marked window does not cover.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = {k: free_name(df, k) for k in ("t_words", "t_lines", "t_grams", "t_sorted", "t_marked", "base")}
    words, lines, grams, ordered, marked = (F.col(names[k]) for k in ("t_words", "t_lines", "t_grams", "t_sorted", "t_marked"))
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), F.slice(words, 2, F.greatest(n - 2, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b, F.lit(" ")))
    triples = F.zip_with(pairs, F.slice(words, 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat(a, b))
    none = F.array().cast("array<struct<g:string,p:int>>")
    m = F.size(ordered)
    # neighbours in the sorted order: equal to the one before, or to the one after
    before = F.concat(F.array(F.lit(None).cast("struct<g:string,p:int>")), F.slice(ordered, 1, F.greatest(m - 1, F.lit(0))))
    after = F.slice(ordered, 2, F.greatest(m - 1, F.lit(0)))
    with_before = F.zip_with(ordered, before, lambda x, y: F.struct(x["g"].alias("g"), x["p"].alias("p"), F.coalesce(x["g"] == y["g"], F.lit(False)).alias("d")))
    both = F.zip_with(with_before, after, lambda x, y: F.when(x["d"] | F.coalesce(x["g"] == y["g"], F.lit(False)), x["p"]))
    gaps = F.zip_with(marked, F.slice(marked, 2, F.size(marked)),
                      lambda p, q: F.least(F.coalesce(q - p, F.lit(3)), F.lit(3)))
    out = (
        df.withColumn(names["t_words"], F.filter(F.split(t, SPACE), lambda w: w != ""))
        .withColumn(names["t_lines"], F.filter(F.split(t, "\n"), lambda x: _without(x, SPACE_CHARS) != ""))
        .withColumn(names["t_grams"], triples)
        .withColumn(names["t_sorted"], F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda g, p: F.struct(g.alias("g"), p.alias("p"))))).otherwise(none))
        .withColumn(names["t_marked"], F.sort_array(F.filter(both, lambda p: p.isNotNull())))
    )
    base = F.struct(
        n.cast("long").alias("n_words"),
        F.length(_without(t, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # one-element explode: filters on the counts stay above it, else they would repeat this work below
    return out.select(*df.columns, F.explode(F.array(base)).alias(names["base"]))


def base_failed(b, limits: Limits) -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (b("n_words") < limits.min_words) | (100 * b("n_repeat_words") > limits.repeat_percent * b("n_words"))


def soft_failed(b, limits: Limits, strict: bool) -> Column:
    """The rules beyond the base rule; strict ones for documents of hosts with a bad verdict."""
    symbols = limits.strict_symbols_per_100_words if strict else limits.symbols_per_100_words
    dups = limits.strict_dup_line_percent if strict else limits.dup_line_percent
    return (
        (100 * b("n_symbols") > symbols * b("n_words"))
        | (100 * b("n_dup_lines") > dups * b("n_lines"))
        | (10 * b("word_chars") < limits.min_word_chars_x10 * b("n_words"))
        | (10 * b("word_chars") > limits.max_word_chars_x10 * b("n_words"))
    )


def host_rates(failures: DataFrame, host: str, failed: str, limits: Limits = Limits()) -> DataFrame:
    """Per host: n_docs, n_failed, the failure rate shrunk by an empirical beta prior, and whether it is bad.

    The prior Beta(a, b) has the mean and the variance of the hosts' own rates (moments over
    all hosts): a + b = mean (1 - mean) / variance - 1, at least 1. With one host, or equal
    rates, the variance is 0 and every host gets the common mean; then only ``host_limit`` makes a host bad.
    """
    hosts = failures.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).select(F.struct("mean", "var")).scalar()
    mean, var = spread["mean"], spread["var"]
    weight = F.greatest(mean * (1 - mean) / F.when(var > 1e-12, var) - 1, F.lit(1.0))
    shrunk = F.when(weight.isNull(), mean).otherwise((F.col("n_failed") + weight * mean) / (F.col("n_docs") + weight))
    bad_from = F.least(F.lit(limits.host_limit), F.when(var > 1e-12, mean + limits.host_deviations * F.sqrt(var)))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("bad", F.col("shrunk_rate") >= bad_from)


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, host_bad and kept.

    The counts are stored once: host totals and verdicts both read them.
    """
    counts = base_counts(docs.select("doc_id", F.col(host).alias("host"), "text")).select("doc_id", "host", "base.*")
    counts = stored(counts, "quality")
    b = F.col
    flagged = counts.withColumn("base_failed", base_failed(b, limits)).withColumn(
        "failed", F.col("base_failed") | soft_failed(b, limits, strict=False))
    hosts = host_rates(flagged, "host", "failed", limits).select(F.col("host").alias("judged_host"), F.col("bad").alias("host_bad"))
    joined = flagged.join(hosts, F.col("host").eqNullSafe(F.col("judged_host")), "left")
    fails = F.when(F.col("host_bad"), soft_failed(b, limits, strict=True)).otherwise(soft_failed(b, limits, strict=False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_bad", (~F.col("base_failed") & ~fails).alias("kept"))


def keep_good(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they came.

    The texts are counted once: the rows are stored with what they pass, and the host totals and the
    verdicts read that. Rows are never shuffled; only the hosts' verdicts join to them.
    """
    name = free_name(docs, "base")
    counted = base_counts(docs)
    b = lambda field: F.col(f"{name}.{field}")
    passes = ~base_failed(b, limits) & ~soft_failed(b, limits, strict=False)
    strict = ~base_failed(b, limits) & ~soft_failed(b, limits, strict=True)
    one, other, key, seen = (free_name(docs, k) for k in ("passes", "passes_strict", "bad_host", "host_is_bad"))
    flagged = stored(counted.withColumn(one, passes).withColumn(other, strict).drop(name), "quality-flags")
    totals = flagged.select(F.col(host).alias("host"), (~F.col(one)).alias("failed"))
    bad = stored(host_rates(totals, "host", "failed", limits).where("bad").select("host"), "bad-hosts")
    verdicts = bad.select(F.col("host").alias(key), F.lit(True).alias(seen))
    joined = flagged.where(F.col(one)).join(verdicts, F.col(host).eqNullSafe(F.col(key)), "left")
    return joined.where(F.col(seen).isNull() | F.col(other)).select(*docs.columns)
