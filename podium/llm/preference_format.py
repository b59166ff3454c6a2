"""Preference pairs as a shared prompt and two masked completions, with DataFrame functions only.

Two conversations of a pair are compared turn by turn. The turns before the first one that differs (in
role or text, or that only one side has) are the prompt, rendered once; from there on each side is a
completion. Every turn is one segment row (pair, part, turn): the text as a model sees it, and the range of its
characters that is trained on: an assistant's text with the end mark in a completion, nothing elsewhere.

No conversation is gathered in one place: the first difference is a partial aggregate over turns, so a conversation
that holds a third of all turns is spread by turn. ``rendered`` puts a part's segments together where
whole strings are wanted.

Defined results: a null text renders as empty and a null role as ``unknown``; null equals null in the
comparison. A null turn comes before all others. Several rows for a turn of a conversation count as the least of
them by role and text, so repeated rows change nothing. A null pair id is a pair of its own. A side that
is missing gives no completion. Other columns are not read. Empty tables give no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = -(1 << 63)
END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))


def turns(conversations: DataFrame, pair: str = "conv_id") -> DataFrame:
    """pair_id, turn and said (role, text), one row per turn."""
    return conversations.groupBy(
        F.col(pair).cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
    ).agg(F.min(F.struct(F.col("role").alias("role"), F.col("text").alias("text"))).alias("said"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, role, segment, train_begin and train_end of all turns of
    the pairs whose sides are given as ``turns`` tables."""
    sides = chosen.select("pair_id", "turn", F.col("said").alias("c"), F.lit(None).cast(chosen.schema["said"].dataType).alias("r")).unionByName(
        rejected.select("pair_id", "turn", F.lit(None).cast(rejected.schema["said"].dataType).alias("c"), F.col("said").alias("r")))
    both = sides.groupBy("pair_id", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r"))
    same = F.col("c").isNotNull() & F.col("c").eqNullSafe(F.col("r"))
    first = both.where(~same).groupBy(F.col("pair_id").alias("differing")).agg(F.min("turn").alias("first"))
    marked = both.join(first, F.col("pair_id").eqNullSafe(F.col("differing")), "left")
    prompt = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    part = lambda name, said: F.struct(F.lit(name).alias("part"), said.alias("said"))
    parts = F.when(prompt, F.array(part("prompt", F.col("c")))).otherwise(
        F.array(part("chosen", F.col("c")), part("rejected", F.col("r"))))
    rows = marked.select("pair_id", "turn", F.explode(parts).alias("x")).where(F.col("x.said").isNotNull())
    role, text = F.col("x.said.role"), F.coalesce(F.col("x.said.text"), F.lit(""))
    segment = F.concat(_header(role), text, F.lit(END))
    trained = (F.col("x.part") != "prompt") & F.coalesce(role == "assistant", F.lit(False))
    return rows.select(
        "pair_id", F.col("x.part").alias("part"), "turn", role.alias("role"), segment.alias("segment"),
        F.when(trained, F.length(_header(role))).otherwise(0).cast("long").alias("train_begin"),
        F.when(trained, F.length(segment)).otherwise(0).cast("long").alias("train_end"))


def rendered(segments: DataFrame) -> DataFrame:
    """pair_id, part, text (the part's segments in turn order) and the trained ranges in it. A
    row holds a whole part, as long as the conversation is."""
    rows = segments.groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(
        F.struct("turn", "segment", "train_begin", "train_end"))).alias("s"))
    start = lambda i: F.length(F.array_join(F.transform(F.slice("s", 1, i), lambda x: x["segment"]), ""))
    spans = F.filter(F.transform("s", lambda x, i: F.when(x["train_end"] > 0, F.struct(
        (start(i) + x["train_begin"]).alias("begin"), (start(i) + x["train_end"]).alias("end")))), lambda x: x.isNotNull())
    return rows.select("pair_id", "part", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), spans.alias("trained"))


def with_echo_answer(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs out of plain conversations. Chosen: the conversation up to its last assistant turn (all of it if
    there is none). Rejected: the same with that last answer replaced by an echo of the turn before it (an
    empty answer if there is none)."""
    own = turns(conversations)
    last = own.where(F.col("said.role") == "assistant").groupBy(F.col("pair_id").alias("answered")).agg(F.max("turn").alias("last"))
    marked = own.join(last, F.col("pair_id").eqNullSafe(F.col("answered")), "left")
    chosen = marked.where(F.col("last").isNull() | (F.col("turn") <= F.col("last"))).select("pair_id", "turn", "said")
    before = marked.where(F.col("turn") < F.col("last"))
    echoed = before.groupBy(F.col("pair_id").alias("echo_id")).agg(F.max(F.struct("turn", F.col("said.text").alias("text")))["text"].alias("echo"))
    answer = last.join(echoed, F.col("answered").eqNullSafe(F.col("echo_id")), "left").select(
        F.col("answered").alias("pair_id"), F.col("last").alias("turn"),
        F.struct(F.lit("assistant").alias("role"), F.coalesce("echo", F.lit("")).alias("text")).alias("said"))
    kept = marked.where(F.col("last").isNull() | (F.col("turn") < F.col("last"))).select("pair_id", "turn", "said")
    return chosen, kept.unionByName(answer)
