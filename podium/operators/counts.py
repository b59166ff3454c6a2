"""Rules checked on maintained counts (R1-R4, X3), not on the base.

A rule asks how many rows a group holds, so the groups' counts are all it needs. They are stored once and
kept by signed changes: a batch appends, for each group that it touches, how many rows came or went. A group's
count is the sum of its entries. A check after a batch reads the entries of the batch's groups -
from the files whose range of the leading group column holds one of them (``Snapshots.read_near``) - and
never the base. The entries of ``MERGED`` batches are added up into one part; groups that come to 0 vanish there.

The changes of all rules become visible in one commit, so the counts always belong to one state of the tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from podium.operators.hints import join_on_hot_key
from podium.operators.rules import MSG_NUMBER_OWNER, MSG_SEASON_CAP, CapRule, OwnerRule, UniqueRule, _fmt
from podium.sources.snapshots import LISTED, Snapshots

MERGED = 8
LEAD, N, SIGN = "_lead", "_n", "_sign"


def group_columns(rule) -> list[str]:
    """What a rule counts rows by; an owner rule counts the rows of each owner."""
    if isinstance(rule, UniqueRule):
        return [rule.race, rule.key]
    if isinstance(rule, OwnerRule):
        return [rule.season, rule.number, rule.owner]
    return list(rule.group)


def counted(rule, rows: DataFrame, races: DataFrame | None) -> DataFrame:
    """The rows' groups with their number: group columns and ``_n``. Rows that the rule exempts are left out. rows: results (races for a
    cap rule); with a column ``_sign`` its sum is the number. The count is partial before any shuffle; the gate's season joins the groups, not the rows."""
    columns = group_columns(rule)
    number = (F.sum(SIGN) if SIGN in rows.columns else F.count(F.lit(1))).alias(N)
    if isinstance(rule, CapRule):
        return rows.groupBy(*columns).agg(number)
    held = [c for c in columns if c != rule.season]
    kept = rows
    for c in held:
        kept = kept.filter(F.col(c).isNotNull())
    by_race = kept.groupBy(*dict.fromkeys([_race(rule), *held])).agg(number).filter(F.col(N) != 0)
    seasons = races.select(_race(rule), rule.season)
    placed = join_on_hot_key(by_race, seasons, _race(rule))
    if rule.from_year is not None:
        placed = placed.filter(F.col(rule.season) >= rule.from_year)
    if isinstance(rule, UniqueRule):  # the groups name the race, so they are whole
        return placed.select(*columns, N)
    return placed.groupBy(*columns).agg(F.sum(N).alias(N))


def _race(rule) -> str:
    return rule.race if isinstance(rule, UniqueRule) else "RaceId"


class RuleCounts:
    """The counts of some rules, in a store of their own."""

    def __init__(self, store: Snapshots, rules: Sequence):
        self.store, self.rules = store, {r.name: r for r in rules}

    def build(self, results: DataFrame, races: DataFrame) -> int:
        """Count the groups of the whole tables: the one time that the base is read."""
        changed = {}
        for name, rule in self.rules.items():
            rows = self._led(rule, counted(rule, races if isinstance(rule, CapRule) else results, races))
            schema = StructType([StructField(f.name, f.dataType, True) for f in rows.schema.fields])
            changed[name] = {"schema": schema.jsonValue(), "parts": self._parts(name, rule, rows, merged=True)}
        return self.store.commit(self.store.version(), changed)

    def apply(self, races: DataFrame, *, added: Mapping[str, DataFrame] | None = None, removed: Mapping[str, DataFrame] | None = None) -> int:
        """Count a batch's rows in and out. added, removed: the rows of ``results`` and ``races`` that came and went; an
        updated row went as it was and came as it is. races: the seasons of all races the rows name."""
        base = self.store.version()
        state = self.store._state(base)
        changed = {}
        for name, rule in self.rules.items():
            table = "races" if isinstance(rule, CapRule) else "results"
            signed = [rows[table].withColumn(SIGN, F.lit(sign)) for rows, sign in ((added or {}, 1), (removed or {}, -1)) if table in rows]
            if not signed:
                continue
            asked = [*dict.fromkeys([*([] if isinstance(rule, CapRule) else [_race(rule)]), *[c for c in group_columns(rule) if isinstance(rule, CapRule) or c != rule.season]]), SIGN]
            signed = [rows.select(*asked) for rows in signed]
            delta = counted(rule, signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1]), races).filter(F.col(N) != 0)
            parts = state[name]["parts"] + self._parts(name, rule, self._led(rule, delta))
            small = [p for p in parts if not p.get("merged")]
            if len(small) >= MERGED:
                total = self._summed(rule, self.store._frame({**state[name], "parts": small}))
                parts = [p for p in parts if p.get("merged")] + self._parts(name, rule, self._led(rule, total), merged=True)
            changed[name] = {**state[name], "parts": parts}
        return self.store.commit(base, changed)

    def _parts(self, name: str, rule, rows: DataFrame, merged: bool = False) -> list[dict]:
        part = self.store.put_aside(name, rows, cluster=[LEAD, *group_columns(rule)], ranges=[LEAD], files=None if merged else 0)
        return [{**part, "merged": merged}] if part["ranges"] else []

    def _led(self, rule, rows: DataFrame) -> DataFrame:
        """The leading group column again, as a whole number or a string, for the files' ranges."""
        lead = group_columns(rule)[0]
        kind = "long" if isinstance(rows.schema[lead].dataType, IntegralType) else "string"
        return rows.withColumn(LEAD, F.col(lead).cast(kind)).withColumn(N, F.col(N).cast(LongType()))

    def _summed(self, rule, entries: DataFrame) -> DataFrame:
        return entries.groupBy(*group_columns(rule)).agg(F.sum(N).alias(N)).filter(F.col(N) != 0)

    def counts(self, name: str, touched: DataFrame | None = None) -> DataFrame:
        """The counts of a rule's groups; touched: rows with the group columns (without the owner), whose groups
        alone are read."""
        rule, version = self.rules[name], self.store.version()
        if touched is None:
            return self._summed(rule, self.store.read(name, version))
        keys = [c for c in group_columns(rule) if not isinstance(rule, OwnerRule) or c != rule.owner]
        groups = touched.select(*keys).distinct()
        lead = self._led(rule, touched.select(*dict.fromkeys([keys[0], *group_columns(rule)[:1]]), F.lit(0).alias(N)))
        if not lead.schema[LEAD].dataType.simpleString() == self.store.read(name, version).schema[LEAD].dataType.simpleString():
            raise TypeError(f"{keys[0]} of the touched rows has another type than the counts'")
        values = [r[0] for r in lead.select(LEAD).where(F.col(LEAD).isNotNull()).distinct().limit(LISTED + 1).collect()]
        near = [(v, v) for v in values] if len(values) <= LISTED else [tuple(lead.agg(F.min(LEAD), F.max(LEAD)).first())]
        return self._summed(rule, join_on_hot_key(self.store.read_near(name, version, {LEAD: near}), groups, keys, "left_semi"))

    def violations(self, name: str, touched: DataFrame | None = None) -> DataFrame:
        """What ``rules.violations`` reports for the rule, from the counts."""
        rule, held = self.rules[name], self.counts(name, touched).filter(F.col(N) > 0)
        if isinstance(rule, UniqueRule):
            return held.filter(F.col(N) > 1).select(rule.race, rule.key, F.col(N).alias("Count")).withColumn(
                "Message", _fmt(rule.message, race=F.col(rule.race), key=F.col(rule.key), count=F.col("Count")))
        if isinstance(rule, OwnerRule):
            owners = held.groupBy(rule.season, rule.number).agg(F.count(F.lit(1)).alias("Drivers")).filter(F.col("Drivers") > 1)
            return owners.withColumn("Message", F.lit(MSG_NUMBER_OWNER))
        season = F.concat_ws("/", *[F.col(c).cast("string") for c in rule.group])
        return held.filter(F.col(N) > rule.cap).select(*rule.group, F.col(N).alias("Count")).withColumn(
            "Message", _fmt(MSG_SEASON_CAP, cap=F.lit(rule.cap), season=season))
