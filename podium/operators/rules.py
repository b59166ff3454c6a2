"""Integrity rules R1-R4 as set-based validators (the reference's AFTER triggers, X3).

A rule inspects a table state (base, or base with a change batch applied) and
returns its violations as rows; an empty frame means the state is accepted.
``touched`` restricts the check to the groups a change batch touched, like the
trigger's ``inserted`` pseudo-table. Every check is a grouped aggregate with a
HAVING filter (G12 duplicates, G13 capacity): partial aggregation before the
shuffle, no self-join, no pairs. Gates are comparisons (P4); NULL keys are
exempt, which is what the procedures' ``Position = @Position`` gives for a NULL
argument (P7). Where a trigger takes ``TOP 1`` violation for its message (O5),
these return every violating group; ``publish`` shows a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Error texts of the reference's triggers and procedures, verbatim
# (the cap is a parameter, so its number is filled in).
MSG_DUP_POSITION = "Duplicate position detected: RaceId = {race}, Position = {key}, Count = {count}"
MSG_DUP_DRIVER = "Duplicate driver detected: RaceId = {race}, DriverId = {key}, Count = {count}"
MSG_SEASON_CAP = "Season with more than {cap} races detected: RaceYear = {season}"
MSG_NUMBER_OWNER = "ResultNumber already used by another driver in this season"
MSG_RACE_MISSING = "Race does not exist"
MSG_RESULT_MISSING = "Result does not exist"
MSG_POSITION_TAKEN = "Position is already occupied in race"
MSG_DRIVER_TAKEN = "Driver already has a result in this race"
MSG_CAP_INSERT = "The number of races in the season will exceed {cap} with the insertion of a new one."
MSG_CAP_MOVE = "The number of races in the season will exceed {cap} with the addition of a new one."

# Our own texts for what the reference leaves to the tables' primary and foreign keys.
MSG_KEY_EXISTS = "Key already exists"
MSG_KEY_REPEATED = "Key is repeated in the batch"
MSG_PARENT_MISSING = "{name} does not exist"


@dataclass(frozen=True)
class UniqueRule:
    """At most one row per (race, key) from season ``from_year`` on; NULL keys exempt."""

    name: str
    race: str
    key: str
    from_year: int | None
    message: str
    create_message: str
    season: str = "RaceYear"


@dataclass(frozen=True)
class CapRule:
    """At most ``cap`` races per season group."""

    name: str
    group: tuple[str, ...]
    cap: int
    race: str = "RaceId"


@dataclass(frozen=True)
class OwnerRule:
    """A number belongs to one driver per season from ``from_year`` on; NULL numbers exempt."""

    name: str
    number: str
    owner: str
    from_year: int | None
    season: str = "RaceYear"


def position_rule(from_year: int | None = 1962, race: str = "RaceId", position: str = "Position",
                  season: str = "RaceYear") -> UniqueRule:
    return UniqueRule("R1", race, position, from_year, MSG_DUP_POSITION, MSG_POSITION_TAKEN, season)


def driver_rule(from_year: int | None = 1979, race: str = "RaceId", driver: str = "DriverId",
                season: str = "RaceYear") -> UniqueRule:
    return UniqueRule("R2", race, driver, from_year, MSG_DUP_DRIVER, MSG_DRIVER_TAKEN, season)


def season_cap_rule(cap: int = 25, group: tuple[str, ...] = ("RaceYear",),
                    race: str = "RaceId") -> CapRule:
    return CapRule("R3", tuple(group), cap, race)


def number_owner_rule(from_year: int | None = 2014, number: str = "ResultNumber",
                      owner: str = "DriverId", season: str = "RaceYear") -> OwnerRule:
    return OwnerRule("R4", number, owner, from_year, season)


def with_season(results: DataFrame, races: DataFrame, *, race: str = "RaceId",
                season: str = "RaceYear") -> DataFrame:
    """Attach each result's season (the trigger's join with Race)."""
    return results.join(races.select(race, season), race)


def _gate(df: DataFrame, season: str, from_year: int | None) -> DataFrame:
    return df if from_year is None else df.filter(F.col(season) >= from_year)


def _fmt(template: str, **cols) -> F.Column:
    """Fill ``{name}`` slots of a fixed message with column values (F2 CONCAT)."""
    parts, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        slot, rest = tail.split("}", 1)
        parts += [F.lit(head), cols[slot].cast("string")]
    parts.append(F.lit(rest))
    return F.concat_ws("", *parts)


def unique_violations(rule: UniqueRule, rows: DataFrame, touched: DataFrame | None = None,
                      touch_mode: str = "pairwise", races: DataFrame | None = None) -> DataFrame:
    """``race, key, Count, Message`` for every (race, key) held more than once.

    rows: results. races: the races with their season, for the gate; without them ``rows`` must
    have the season itself. The rows are counted per (race, key) first, a partial aggregate on
    the scan's side; only the duplicate groups meet the touched keys and the gate,
    which concern whole groups. touched: the change batch (rows with the race and key columns). ``touch_mode="pairwise"`` checks the touched (race,
    key) pairs; ``"touched_groups"`` reproduces the reference's two independent
    ``IN`` lists (race in batch and key in batch), which can also flag an old
    duplicate the batch did not touch (trap T16).
    """
    keyed = rows.filter(F.col(rule.key).isNotNull())
    if races is None:
        keyed = _gate(keyed, rule.season, rule.from_year)
    r = (keyed.groupBy(rule.race, rule.key).agg(F.count(F.lit(1)).alias("Count"))
         .filter(F.col("Count") > 1))
    if races is not None:  # like the trigger's join with Race: a result of no race is not checked
        r = _gate(r.join(races.select(rule.race, rule.season), rule.race), rule.season, rule.from_year)
    if touched is not None:
        if touch_mode == "pairwise":
            r = r.join(touched.select(rule.race, rule.key).distinct(), [rule.race, rule.key], "left_semi")
        elif touch_mode == "touched_groups":
            r = (r.join(touched.select(rule.race).distinct(), rule.race, "left_semi")
                 .join(touched.select(rule.key).distinct(), rule.key, "left_semi"))
        elif touch_mode == "races":
            r = r.join(touched.select(rule.race).distinct(), rule.race, "left_semi")
        else:
            raise ValueError(f"unknown touch_mode {touch_mode!r}")
    return r.select(rule.race, rule.key, "Count").withColumn(
        "Message", _fmt(rule.message, race=F.col(rule.race), key=F.col(rule.key), count=F.col("Count")))


def cap_violations(rule: CapRule, races: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``group..., Count, Message`` for season groups with more than ``cap`` races."""
    r = races
    if touched is not None:
        r = r.join(touched.select(*rule.group).distinct(), list(rule.group), "left_semi")
    grouped = (r.groupBy(*rule.group).agg(F.count(F.lit(1)).alias("Count"))
               .filter(F.col("Count") > rule.cap))
    season_txt = F.concat_ws("/", *[F.col(c).cast("string") for c in rule.group])
    return grouped.withColumn("Message", _fmt(MSG_SEASON_CAP, cap=F.lit(rule.cap), season=season_txt))


def owner_violations(rule: OwnerRule, rows: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``season, number, Drivers, Message`` for numbers used by more than one driver.

    The trigger's pairwise self-join (J11, "another row, other driver") is the
    grouped test ``count(distinct driver) > 1`` - two rows conflict exactly when
    their group holds two drivers - and costs one aggregation instead of a
    quadratic join on hot numbers. touched: changed rows with season and number.
    """
    r = _gate(rows.filter(F.col(rule.number).isNotNull() & F.col(rule.owner).isNotNull()),
              rule.season, rule.from_year)
    keys = [rule.season, rule.number]
    if touched is not None:
        t = _gate(touched.filter(F.col(rule.number).isNotNull()), rule.season, rule.from_year)
        r = r.join(t.select(*keys).distinct(), keys, "left_semi")
    owners = r.select(*keys, rule.owner).distinct()  # map-side distinct: hot numbers collapse
    grouped = (owners.groupBy(*keys).agg(F.count(F.lit(1)).alias("Drivers"))
               .filter(F.col("Drivers") > 1))
    return grouped.withColumn("Message", F.lit(MSG_NUMBER_OWNER))


def violations(rule, rows: DataFrame, touched: DataFrame | None = None, **kw) -> DataFrame:
    """Dispatch on the rule type."""
    if isinstance(rule, UniqueRule):
        return unique_violations(rule, rows, touched, **kw)
    if isinstance(rule, CapRule):
        return cap_violations(rule, rows, touched)
    if isinstance(rule, OwnerRule):
        return owner_violations(rule, rows, touched)
    raise TypeError(f"not a rule: {rule!r}")
