"""Staged result file -> new circuits, constructors, drivers, seasons and races (I5), results.

The staging table (S6) is a DataFrame read by every step; callers that stage
from an expensive source persist it first. Appending the returned rows is S7.

Every step is "distinct natural keys of the staging rows, minus what the
dimension already holds (anti-join), numbered on from the current maximum"
(``load_dimension``), and the facts resolve their dimensions by natural key
before the same anti-join (``load_fact``). Running the job twice adds nothing
the second time.

Decisions that differ from the reference on purpose (SURVEY 6.2):
- the constructor default 'UNKNOWN' is applied before the anti-join (I3), so a
  second run does not add it again;
- drivers are identified by name, not by car number (trap T4): the number is
  kept in ``DriverNumber`` and the id comes from the key sequence;
- races are identified by (season, round); ``RaceDate`` is a parameter, not the
  clock (F17), so a run is reproducible.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions import after_first_word, first_word, full_name, idiv
from podium.operators.hints import join_on_hot_key
from podium.operators.keys import current_max, dense_index


def load_dimension(candidates: DataFrame, existing: DataFrame, *, natural_key: Mapping[str, Column],
                   surrogate: str | None, order: Sequence[str],
                   attributes: Mapping[str, Column],
                   existing_key: Mapping[str, Column] | None = None) -> DataFrame:
    """New dimension rows for the candidates the dimension does not hold yet.

    natural_key: name -> expression over the candidates; existing_key: the same
    names over the dimension (default: its columns of those names; pass
    ``lower()`` on both for a case-insensitive match). attributes: output column
    -> expression over the candidates; of several spellings of a key the least row of attributes
    holds, so runs agree. The surrogate continues from ``MAX(surrogate)`` (I6).
    """
    extra = [n for n in attributes if n not in natural_key]
    keyed = candidates.select(*[e.alias(n) for n, e in natural_key.items()], *[attributes[n].alias(n) for n in extra])
    if extra:  # G9
        keyed = (keyed.groupBy(*natural_key).agg(F.min(F.struct(*extra)).alias("_attributes"))
                 .select(*natural_key, "_attributes.*"))
    else:
        keyed = keyed.distinct()
    ex_key = existing_key or {n: F.col(n) for n in natural_key}
    known = existing.select(*[e.alias(n) for n, e in ex_key.items()]).distinct()
    new = keyed.join(known, list(natural_key), "left_anti")  # J9 NOT EXISTS
    if surrogate is not None:
        new = dense_index(new, order, out=surrogate, offset=current_max(existing, surrogate))
    return new


def load_fact(staged: DataFrame, existing: DataFrame, *, natural_key: Sequence[str], surrogate: str,
              order: Sequence[str]) -> DataFrame:
    """Staged fact rows whose natural key is not in the fact table yet, numbered on."""
    new = staged.join(existing.select(*natural_key).distinct(), list(natural_key), "left_anti")
    return dense_index(new, order, out=surrogate, offset=current_max(existing, surrogate))


def ingest_race_results(stage: DataFrame, tables: Mapping[str, DataFrame], *,
                        race_date: dt.date | str = "1970-01-01",
                        keep: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows) -> dict[str, DataFrame]:
    """Run I2-I7 over a staged sprint-result file (columns of RACE_RESULT_FIELDS).

    tables: current ``Circuit``, ``Constructor``, ``Driver``, ``Season``, ``Race``,
    ``Result`` DataFrames. Returns the rows to append per table; each later step
    resolves against the dimension including the rows added before it. ``Unresolved`` holds the
    staged lines that became no result, with the reason. keep: stores a table's new rows as soon as they are
    numbered and gives them back, so that the later steps read them instead of computing them again.
    """
    # a blank or missing car is unknown; the default goes in before the anti-join
    stage = stage.withColumn("Car", F.coalesce(F.nullif(F.trim("Car"), F.lit("")), F.lit("UNKNOWN")))
    out: dict[str, DataFrame] = {}

    circuit = tables["Circuit"]
    out["Circuit"] = keep("Circuit", _new_circuits(stage, circuit))
    circuits = circuit.unionByName(out["Circuit"], allowMissingColumns=True)

    constructor = tables["Constructor"]
    out["Constructor"] = keep("Constructor", _new_constructors(stage, constructor))
    constructors = constructor.unionByName(out["Constructor"], allowMissingColumns=True)

    driver = tables["Driver"]
    out["Driver"] = keep("Driver", _new_drivers(stage, driver))
    drivers = driver.unionByName(out["Driver"], allowMissingColumns=True)

    season = tables["Season"]
    out["Season"] = keep("Season", load_dimension(
        stage.filter(F.col("RaceNr").isNotNull()), season,
        natural_key={"RaceYear": idiv("RaceNr", F.lit(100)).cast("int")}, surrogate=None, order=[],
        attributes={"SeasonUrl": F.lit("")}))

    race = tables["Race"]
    out["Race"] = keep("Race", _new_races(stage, race, circuits, race_date))
    races = race.unionByName(out["Race"], allowMissingColumns=True)

    resolved = _resolve(stage, races, drivers, constructors)
    out["Result"] = keep("Result", _new_results(resolved, tables["Result"]))
    out["Unresolved"] = unresolved(resolved).select(*stage.columns, "reason")
    return out


def _new_circuits(stage: DataFrame, circuit: DataFrame) -> DataFrame:
    """Circuits named in the stage and not yet known, ids continuing from MAX(CircuitId)."""
    new = load_dimension(stage.filter(F.col("Circuit").isNotNull()), circuit,
                         natural_key={"CircuitName": F.col("Circuit")}, surrogate="CircuitId",
                         order=["CircuitName"], attributes={})
    return new.select(F.col("CircuitId").cast("int").alias("CircuitId"),
                      F.col("CircuitName").alias("CircuitRef"), "CircuitName",
                      F.col("CircuitName").alias("CircuitLocation"), F.lit("Unknown").alias("Country"))


def _new_constructors(stage: DataFrame, constructor: DataFrame) -> DataFrame:
    """Constructors not yet known (case-insensitive, like the reference's default
    collation), 'UNKNOWN' already applied."""
    new = load_dimension(stage, constructor, natural_key={"_k": F.lower("Car")},
                         existing_key={"_k": F.lower("ContstructorName")}, surrogate="ConstructorId",
                         order=["_k"], attributes={"ContstructorName": F.col("Car")})
    return new.select(F.col("ConstructorId").cast("int").alias("ConstructorId"),
                      F.col("ContstructorName").alias("ConstructorRef"), "ContstructorName",
                      F.lit("Unknown").alias("Nationality"), F.lit("").alias("ConstructorUrl"))


def _driver_key(first: Column, last: Column) -> Column:
    """Case-insensitive name key; trimmed, because a one-word name is stored with an
    empty last name and CONCAT_WS keeps the separator before ''."""
    return F.lower(F.trim(full_name(first, last)))


def _staged_driver_key(name: str = "Driver") -> Column:
    return F.lower(F.trim(F.col(name)))


def _new_drivers(stage: DataFrame, driver: DataFrame) -> DataFrame:
    """I4: drivers not yet known by name; the name is split at the first space
    and the car number kept as DriverNumber (trap T4)."""
    named = stage.filter(F.col("Driver").isNotNull() & (F.trim("Driver") != ""))
    cand = (named.groupBy(_staged_driver_key().alias("_k"))
            .agg(F.min(F.trim("Driver")).alias("Driver"),
                 F.max(F.struct("RaceNr", "NO"))["NO"].alias("DriverNumber")))  # latest number used
    new = load_dimension(cand, driver, natural_key={"_k": F.col("_k")},
                         existing_key={"_k": _driver_key(F.col("Firstname"), F.col("Lastname"))}, surrogate="DriverId",
                         order=["_k"], attributes={"Driver": F.col("Driver"), "DriverNumber": F.col("DriverNumber")})
    return new.select(F.col("DriverId").cast("int").alias("DriverId"), F.col("Driver").alias("DriverRef"),
                      F.col("DriverNumber").cast("int").alias("DriverNumber"),
                      first_word("Driver").alias("Firstname"), after_first_word("Driver").alias("Lastname"),
                      F.lit("Unknown").alias("Nationality"))


def _season_round(stage: DataFrame) -> DataFrame:
    """RaceNr split into season and round (F16)."""
    return (stage.withColumn("RaceYear", idiv("RaceNr", F.lit(100)).cast("int"))
            .withColumn("NrOfRound", (F.col("RaceNr") % 100).cast("int")))


def _one_id(dimension: DataFrame, key: Column, surrogate: str, alias: str) -> DataFrame:
    """Natural key -> lowest id, and how many ids carry it: a key side that never multiplies rows."""
    return (dimension.groupBy(key.alias(alias))
            .agg(F.min(surrogate).alias(surrogate), F.count(F.lit(1)).alias(f"{alias}_ids")))


def _new_races(stage: DataFrame, race: DataFrame, circuits: DataFrame, race_date) -> DataFrame:
    """Races by (season, round) from RaceNr div/mod 100, circuit resolved by name. A race
    whose lines name no circuit cannot be stored; its lines are reported by ``unresolved``."""
    named = _season_round(stage.filter(F.col("RaceNr").isNotNull() & F.col("Circuit").isNotNull()))
    ids = _one_id(circuits, F.col("CircuitName"), "CircuitId", "CircuitName").select("CircuitName", "CircuitId")
    new = load_dimension(
        named, race, natural_key={"RaceYear": F.col("RaceYear"), "NrOfRound": F.col("NrOfRound")},
        surrogate="RaceId", order=["RaceYear", "NrOfRound"], attributes={"CircuitName": F.col("Circuit")})
    return new.join(ids, "CircuitName").select(
        F.col("RaceId").cast("int").alias("RaceId"), "RaceYear", "NrOfRound",
        F.col("CircuitId").cast("int").alias("CircuitId"), F.col("CircuitName").alias("RaceName"),
        F.lit(str(race_date)).cast("date").alias("RaceDate"))


def _resolve(stage: DataFrame, races: DataFrame, drivers: DataFrame, constructors: DataFrame) -> DataFrame:
    """Every staged line with the ids of its race, driver and constructor (NULL where there is none)."""
    race_ids = (races.groupBy("RaceYear", "NrOfRound").agg(F.min("RaceId").alias("RaceId")))
    driver_ids = _one_id(drivers, _driver_key(F.col("Firstname"), F.col("Lastname")), "DriverId", "_dk")
    car_ids = _one_id(constructors, F.lower("ContstructorName"), "ConstructorId", "_ck")
    lines = _season_round(stage).withColumns({"_dk": _staged_driver_key(), "_ck": F.lower("Car")})
    return _look_up(_look_up(_look_up(lines, race_ids, ["RaceYear", "NrOfRound"]), driver_ids, ["_dk"]), car_ids, ["_ck"])


def _look_up(lines: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The lines with the ids of their keys (NULL where there are none), in one pass. A key with most lines is split; lines without
    a key are dealt by their other columns, so they do not meet in one partition."""
    return join_on_hot_key(lines, ids, keys, "left", spread_nulls=True)


def unresolved(resolved: DataFrame) -> DataFrame:
    """Staged lines that became no result, or whose driver's name stands for several drivers (the lowest
    id is taken), with the reason."""
    reason = F.concat_ws(
        "; ", F.when(F.col("RaceNr").isNull(), F.lit("race number is missing"))
        .when(F.col("RaceId").isNull(), F.lit("race has no circuit")),
        F.when(F.coalesce(F.trim("Driver"), F.lit("")) == "", F.lit("driver is missing")),
        F.when(F.col("_dk_ids") > 1, F.lit("driver name is not unique, lowest id taken")))
    return resolved.withColumn("reason", reason).filter(F.col("reason") != "")


def _new_results(resolved: DataFrame, result: DataFrame) -> DataFrame:
    """Lines resolved to race, driver and constructor, skipping existing (race, driver)."""
    staged = resolved.filter(F.col("RaceId").isNotNull() & F.col("DriverId").isNotNull()).select(
        "RaceId", "DriverId", "ConstructorId", F.col("NO").alias("ResultNumber"), F.col("POS").alias("Grid"),
        F.col("POS").alias("Position"), F.col("POS").cast("string").alias("PositionText"),
        F.col("POS").alias("PositionOrder"), F.col("Points").cast("decimal(18,4)").alias("Points"),
        F.col("Laps"), F.col("TimeRetired").alias("Time"), F.lit(1).alias("ResultStatusId"),
        "RaceNr", "POS")
    new = load_fact(staged, result, natural_key=["RaceId", "DriverId"], surrogate="ResultId",
                    order=["RaceNr", "POS", "DriverId", "ConstructorId", "ResultNumber", "Points", "Laps", "Time"])
    return new.withColumn("ResultId", F.col("ResultId").cast("int")).drop("RaceNr", "POS")
