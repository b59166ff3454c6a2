"""Personal data: fixed forms as seeds, and identifiers found by the company they keep.

Base spans are those of four fixed forms (email, ip, card, phone). They seed a bootstrap: the words around a
seed are lexical patterns ("call me _", "mail _ or"), and other identifier-like words, which no form
matches, are candidates where they stand in a pattern's slot. Patterns and values form a graph that is scored
in rounds, each a few joins and sums over the distinct edges:

- a pattern's score for a kind is the mean of its distinct values' scores: a seed of the kind counts 1, a seed of
  another kind 0, a candidate its score so far;
- a pattern counts for a kind once ``support`` distinct values are sure there (seeds, or candidates found sure in
  an earlier round, so patterns are induced from discoveries too);
- a candidate's score for a kind is 1 - product of (1 - score) over the patterns that count and hold it.

Candidates that reach ``sure`` after the last round are spans of their best kind wherever they stand. Scores are
whole thousandths, so they do not depend on the order of sums.

Everything is Spark SQL: matches by ``regexp_extract_all``, their places from the pieces that ``split`` leaves
between them. The expressions are possessive and begin only where a match can begin, so that their time is
linear in the text and their stack constant. Texts are read once; from then on only spans and
candidates are kept, stored with a row number, so repeated or null ids keep their own rows.

Defined results: a null text counts as empty and has no spans; texts are read whole, whatever their length;
repeated rows get spans each. Only ``doc_id`` and ``text`` are read, so other columns and their names do
not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import stored
from podium.operators.hints import join_on_hot_key

KINDS = ("email", "ip", "card", "phone")
WORD = r"[^\x20\x09-\x0D]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: kind -> (a character that every match has, the form). A form may begin where no earlier match could have
#: begun, or right behind the match before.
FORMS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: a word with a digit or an @
CANDIDATE = rf"(?<!{WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD}*+"
#: what does not belong to an identifier at its ends
EDGES = "\"'()[]{}<>.,;:!?#*%$&|"
BLOCK = 256


@dataclass(frozen=True)
class Bootstrap:
    """support: distinct sure values that make a pattern; sure: thousandths from which a value is one;
    rounds: of scoring; digits: that a candidate without @ must have."""

    support: int = 3
    sure: int = 800
    rounds: int = 3
    digits: int = 4


def _running(steps: Column) -> Column:
    """Running totals of an array of ints: block by block, so that long arrays do not sum everything anew."""
    def total(part):
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda b: F.struct(
        total(F.slice(steps, 1, b * BLOCK)).alias("before"), F.slice(steps, b * BLOCK + 1, BLOCK).alias("part")))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(
        blocks, lambda s: F.transform(s["part"], lambda x, i: s["before"] + total(F.slice(s["part"], 1, i + 1))))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit checks the others: every second digit from the right is doubled, its digits added."""
    back = F.reverse(digits)
    terms = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 1, F.substring(back, i, F.lit(1))).otherwise(F.translate(F.substring(back, i, F.lit(1)), "0123456789", "0246813579")).cast("int"))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
    }[kind]


def _matches(text: Column, form: str, needs: str) -> tuple[Column, Column]:
    """The matches of a form, and the pieces of text around them."""
    none = F.array().cast("array<string>")
    may = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return (F.when(may, F.regexp_extract_all(text, F.lit(form), F.lit(0))).otherwise(none),
            F.when(may, F.split(text, form, -1)).otherwise(none))


def _words(piece: Column) -> Column:
    """A piece's words, as patterns see them: ASCII letters lowered, digits as 0."""
    plain = F.translate(piece, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _placed(hits: Column, pieces: Column, ends: Column, kind: int) -> Column:
    """Spans of the matches; ``ends`` are the running totals of piece and match lengths."""
    def span(hit, i):
        before, after = F.reverse(_words(F.get(pieces, i))), _words(F.get(pieces, i + 1))
        return F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("end"), hit.alias("value"),
                        F.get(before, F.lit(1)).alias("left2"), F.get(before, F.lit(0)).alias("left1"), F.get(after, F.lit(0)).alias("right1"))
    return F.transform(hits, span)


def _trimmed(span: Column) -> Column:
    """A candidate without the marks around it."""
    value = span["value"]
    begin = span["start"] + F.length(value) - F.length(F.ltrim(value, F.lit(EDGES)))
    core = F.btrim(value, F.lit(EDGES))
    return F.struct(span["kind"].alias("kind"), begin.alias("start"), (begin + F.length(core)).alias("end"), core.alias("value"),
                    span["left2"].alias("left2"), span["left1"].alias("left1"), span["right1"].alias("right1"))


def spans_and_candidates(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, ``base`` (spans by kind and start: kind, start, end, value and the words around) and ``candidates`` (such spans, of kind -1) of every row.

    Each step stands behind a one-element explode, so that what it computes is not computed again wherever it is read.
    """
    text = F.coalesce("text", F.lit(""))
    forms = {**FORMS, "candidate": ("", CANDIDATE)}
    found = {}
    for kind, (needs, form) in forms.items():
        found[kind] = _matches(text, form, needs)
    step = docs.select("doc_id", F.inline(F.array(F.struct(*[c.alias(f"{name}_{kind}") for kind, pair in found.items()
                                                               for name, c in zip(("hits", "pieces"), pair)]))))

    def lengths(kind):
        return F.transform(f"hits_{kind}", lambda h, i: F.length(F.get(f"pieces_{kind}", i)) + F.length(h))
    step = step.select("*", F.inline(F.array(F.struct(*[lengths(k).alias(k) for k in forms]))))
    step = step.select(*[c for c in step.columns if c not in forms], F.inline(F.array(F.struct(*[_running(F.col(k)).alias(f"ends_{k}") for k in forms]))))
    placed = {k: _placed(F.col(f"hits_{k}"), F.col(f"pieces_{k}"), F.col(f"ends_{k}"), KINDS.index(k) if k in KINDS else -1) for k in forms}

    def valid(kind):
        return F.filter(placed[kind], lambda s: _valid(kind, s["value"]))
    base = F.concat(*[valid(k) for k in KINDS])
    step = step.select("doc_id", F.inline(F.array(F.struct(base.alias("base"), F.transform(placed["candidate"], _trimmed).alias("candidates")))))

    def wanted(c):
        taken = F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return (F.contains(c["value"], F.lit("@")) | (F.length(_digits(c["value"])) >= settings.digits)) & ~taken
    return step.select("doc_id", "base", F.filter("candidates", wanted).alias("candidates"))


def _edges(found: DataFrame, spans: str) -> DataFrame:
    """pattern, value and kind, a row for each pattern of each span."""
    rows = found.select(F.inline(spans)).select("kind", "value", F.explode(F.array(
        F.when(F.col("left1").isNotNull() & F.col("left2").isNotNull(), F.concat_ws(" ", "left2", "left1", F.lit("_"))),
        F.when(F.col("left1").isNotNull() & F.col("right1").isNotNull(), F.concat_ws(" ", "left1", F.lit("_"), "right1")))).alias("pattern"))
    return rows.where(F.col("pattern").isNotNull()).distinct()


def discover(found: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """value, kind and score (thousandths) of the candidates that are sure. found: ``spans_and_candidates``, stored."""
    edges = stored(_edges(found, "base").unionByName(_edges(found, "candidates")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = None
    for _ in range(settings.rounds):
        known = edges.where("kind >= 0").select("pattern", "kind", F.lit(1000).alias("score"))
        if scores is not None:
            held = edges.where("kind < 0").select("pattern", "value")
            known = known.unionByName(join_on_hot_key(held, scores, "value").select("pattern", F.explode("kinds").alias("k")).select("pattern", "k.kind", "k.score"))
        patterns = known.groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count_if(F.col("score") >= settings.sure).alias("held"))
        patterns = patterns.where(F.col("held") >= settings.support).join(sizes, "pattern")
        share = F.least(F.expr("total div n"), F.lit(990))
        # one row per pattern, so that a pattern with most candidates is split where it meets them
        weights = patterns.groupBy("pattern").agg(F.collect_list(F.struct(
            "kind", F.round(-F.log(1 - share / 1000) * 1_000_000).cast("long").alias("weight"))).alias("weights"))
        votes = join_on_hot_key(edges.where("kind < 0").select("pattern", "value"), weights, "pattern").select(
            "value", F.explode("weights").alias("w")).groupBy("value", "w.kind").agg(F.sum("w.weight").alias("weight"))
        scored = votes.select("value", "kind", F.round(1000 * (1 - F.exp(-F.col("weight") / 1_000_000))).cast("int").alias("score"))
        scores = stored(scored.groupBy("value").agg(F.collect_list(F.struct("kind", "score")).alias("kinds")), "pii-scores")
    first = F.element_at(F.array_sort(F.transform("kinds", lambda k: F.struct((-k["score"]).alias("s"), k["kind"].alias("kind")))), 1)
    return scores.select("value", first.alias("best")).select("value", "best.kind", (-F.col("best.s")).alias("score")).where(F.col("score") >= settings.sure)


def personal_data(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per input row: doc_id, ``base`` and ``spans``, arrays of (kind, start, end, value) by kind and start;
    ``spans`` holds the base spans and the discovered ones. Places are code points, the end exclusive."""
    found = stored(spans_and_candidates(docs, settings).withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    sure = stored(discover(found, settings), "pii-sure")
    places = found.select("row", F.explode("candidates").alias("c")).select("row", "c.value", "c.start", "c.end")
    added = join_on_hot_key(places, sure, "value").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("added"))
    out = found.select("row", "doc_id", F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"),
                                                                               b["value"].alias("value"))).alias("base"))
    out = out.join(added, "row", "left")
    return out.select("doc_id", _named("base"), _named(F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(
        "array<struct<kind:int,start:int,end:int,value:string>>")))), "spans"))


def _named(spans: Column | str, name: str | None = None) -> Column:
    """The spans with their kinds' names."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                 s["value"].alias("value"))).alias(name or spans)


def listed(spans: str) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
