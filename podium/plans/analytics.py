"""Registered analytic queries Q1, Q2, Q4, Q5, Q6 on the test tables.

CTE chains and derived tables (Z1, Z2) are DataFrame variables. Reports are
sorted as the reference sorts them (O1 aliases, O2 expressions descending),
with ids as the last keys so ties do not reorder between runs (T14).

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
columns match the DuckDB twin in ``podium.plans.oracle``. Integer outputs are
cast to ``long`` so both engines report BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import full_name
from podium.operators.completion import min_completion
from podium.operators.fastest import fastest_per_group, first_per_group_scalar
from podium.operators.periods import active_periods, driver_seasons, periods_report
from podium.operators.shares import (
    career_wins, career_wins_report, career_wins_two_aggregates, career_wins_window, season_win_share,
    season_win_share_lateral, season_win_share_report, season_win_share_two_pass,
)
from podium.plans import model
from podium.sources.tables import read_tables

# Parameters of the bound questions (the reference's values where they make sense on
# these tables: 90% completion, 25 wins; the season and year window are moved onto
# the years the test data covers).
Q1_SEASON = 2000
Q2_FROM, Q2_TO = 1996, 2000
Q5_MIN_WINS = 25


def q1_min_completion(spark: SparkSession, root: str, method: str = "aggregate") -> DataFrame:
    """Q1 (A/1 options 1 and 3; J1, J5, G2, G3, P9, P11, F1, F5)."""
    t = read_tables(spark, root)
    res = model.result(t).withColumnRenamed("DriverId", "SupplierId").withColumnRenamed("PartId", "DriverId")
    out = min_completion(res, model.race(t, years=(Q1_SEASON, Q1_SEASON)), model.part_driver(t),
                         season_value=Q1_SEASON, method=method)
    return out.select("Name", "Completion", "MinCompletion").orderBy(F.col("MinCompletion").desc(), "Name")


def q1_window(spark: SparkSession, root: str) -> DataFrame:
    """Q1 option 2 (W1: ``MAX(Laps) OVER (PARTITION BY RaceId)``)."""
    return q1_min_completion(spark, root, method="window")


def _q2_races(t) -> DataFrame:
    """The window's races with their date and circuit (context of the chosen results)."""
    return (model.race(t, years=(Q2_FROM, Q2_TO)).filter(F.col("RaceYear").between(Q2_FROM, Q2_TO))
            .select("RaceId", "RaceDate", F.col("CustomerId").alias("c_custkey"))
            .join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
            .join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"),
                                  F.col("n_name").alias("CircuitName")), "c_nationkey")
            .select("RaceId", "RaceDate", "CircuitName"))


def _q2_context(t, fastest: DataFrame, races: DataFrame | None = None) -> DataFrame:
    """J3 star join of the chosen results with race, circuit and driver, sorted by
    circuit and lap time (O1). The join with the window's races is what restricts the
    result to the window: the top-1 per race comes first, on the scan's side of the shuffle."""
    races = _q2_races(t) if races is None else races
    return (fastest
            .join(races, "RaceId")
            .join(model.supplier_driver(t).select("DriverId", "Firstname", "Lastname"), "DriverId")
            .select("CircuitName",
                    F.col("RaceDate").cast("string").alias("RaceDate"),
                    full_name("Firstname", "Lastname").alias("Name"),
                    F.col("FastestLap").cast("long").alias("FastestLap"),
                    "FastestLapTime",
                    F.col("PositionText").alias("Position"),
                    "Points", "Laps", "ResultStatus")
            .orderBy("CircuitName", "FastestLapTime", "RaceDate", "Name"))


def q2_fastest_first(spark: SparkSession, root: str) -> DataFrame:
    """Q2 option 2 (W2 ``ROW_NUMBER`` = 1, P3 BETWEEN, P5, J3): one row per race."""
    t = read_tables(spark, root)
    races = _q2_races(t)
    best = fastest_per_group(model.result(t), group="RaceId", value="FastestLapTime",
                             tiebreak=("Position", "PartId", "DriverId"), ties="first")
    return _q2_context(t, best, races)


def q2_fastest_all_ties(spark: SparkSession, root: str) -> DataFrame:
    """Q2 option 3 (J4: join on the per-race minimum; returns every tie).

    Bound to the fewest laps per race, where ties occur (trap T2)."""
    t = read_tables(spark, root)
    races = _q2_races(t)
    best = fastest_per_group(model.result(t), group="RaceId", value="Laps", ties="all")
    return _q2_context(t, best, races)


def q2_scalar_top1(spark: SparkSession, root: str) -> DataFrame:
    """Q2 option 1 (Z5/O4: scalar ``TOP 1`` per race, NULL for races without a time)."""
    t = read_tables(spark, root)
    races = (model.race(t, years=(Q2_FROM, Q2_TO)).filter(F.col("RaceYear").between(Q2_FROM, Q2_TO))
             .select("RaceId"))
    best = first_per_group_scalar(races, model.result(t), group="RaceId", value="FastestLapTime",
                                  tiebreak=("Position", "PartId", "DriverId"))
    return _q2_context(t, best.filter(F.col("FastestLapTime").isNotNull()))


def _periods(t, driver_table: str):
    if driver_table == "customer":
        # Q4 binding: a customer's active years are the years of its orders.
        pairs = model.race(t).select(F.col("CustomerId").alias("DriverId"), "RaceYear")
        return active_periods(pairs)
    return active_periods(driver_seasons(model.result(t), model.race(t)))


def q4_periods(spark: SparkSession, root: str, min_periods: int = 1) -> DataFrame:
    """Q4 option 1 (S10 view, W5/W6 replaced by islands, G9, G10, F20)."""
    t = read_tables(spark, root)
    drivers = model.customer_driver(t)
    return (periods_report(_periods(t, "customer"), drivers,
                           name_col=full_name("Firstname", "Lastname"), min_periods=min_periods)
            .orderBy("Coureur", "Periodes"))


def q4_returners(spark: SparkSession, root: str) -> DataFrame:
    """Q4 option 2 (only drivers with two or more periods; P6 as an island count)."""
    return q4_periods(spark, root, min_periods=2)


def q5_career_wins(spark: SparkSession, root: str) -> DataFrame:
    """Q5 option 3."""
    t = read_tables(spark, root)
    return _q5_report(t, career_wins(model.result(t), min_wins=Q5_MIN_WINS))


def q5_two_aggregates(spark: SparkSession, root: str) -> DataFrame:
    """Q5 option 1 (two aggregates joined, G5)."""
    t = read_tables(spark, root)
    return _q5_report(t, career_wins_two_aggregates(model.result(t), min_wins=Q5_MIN_WINS))


def q5_window(spark: SparkSession, root: str) -> DataFrame:
    """Q5 option 2 (W3, W4 and DISTINCT, J15)."""
    t = read_tables(spark, root)
    return _q5_report(t, career_wins_window(model.result(t), min_wins=Q5_MIN_WINS))


def q5_distinct_races(spark: SparkSession, root: str) -> DataFrame:
    """Q5 with entries as distinct races (trap T12)."""
    t = read_tables(spark, root)
    return _q5_report(t, career_wins(model.result(t), min_wins=Q5_MIN_WINS, distinct_races=True))


def _q5_report(t, wins: DataFrame) -> DataFrame:
    return (career_wins_report(wins, _periods(t, "supplier"), model.supplier_driver(t),
                               name_col=full_name("Firstname", "Lastname"))
            .withColumn("Entries", F.col("Entries").cast("long"))
            .withColumn("Wins", F.col("Wins").cast("long"))
            .orderBy(F.col("Wins").desc(), "Driver"))


def q6_win_share(spark: SparkSession, root: str) -> DataFrame:
    """Q6 option 2 (single pass: G1 + G4, F6, F10)."""
    t = read_tables(spark, root)
    shares = season_win_share(model.result(t), model.race(t))
    return _q6_report(t, shares)


def q6_left_join(spark: SparkSession, root: str) -> DataFrame:
    """Q6 option 1 (two aggregates, J6 left join + F9 coalesce)."""
    t = read_tables(spark, root)
    return _q6_report(t, season_win_share_two_pass(model.result(t), model.race(t)))


def q6_lateral(spark: SparkSession, root: str) -> DataFrame:
    """Q6 option 3 (correlated counts in a LATERAL subquery)."""
    t = read_tables(spark, root)
    return _q6_report(t, season_win_share_lateral(model.result(t), model.race(t)))


def o3_latest_race(spark: SparkSession, root: str) -> DataFrame:
    """O3: the one latest race, ``TOP 1 ... ORDER BY`` - each task keeps one row, one row per task is
    compared - with its number of results."""
    t = read_tables(spark, root)
    latest = (model.race(t).orderBy(F.col("RaceDate").desc(), F.col("RaceId").desc()).limit(1)
              .select("RaceId", F.col("RaceDate").cast("string").alias("RaceDate")))
    counts = model.result(t).groupBy("RaceId").agg(F.count(F.lit(1)).alias("Results"))
    return latest.join(counts, "RaceId", "left").select("RaceId", "RaceDate", F.coalesce("Results", F.lit(0)).alias("Results"))


def _q6_report(t, shares: DataFrame) -> DataFrame:
    return (season_win_share_report(shares, model.supplier_driver(t),
                                    name_col=full_name("Firstname", "Lastname"))
            .withColumn("Races", F.col("Races").cast("long"))
            .withColumn("Wins", F.col("Wins").cast("long"))
            .orderBy((F.col("Wins") / F.col("Races")).desc(), "Driver", "Season"))


QUERIES = {
    "q1_min_completion": q1_min_completion,
    "q1_window": q1_window,
    "q2_fastest_first": q2_fastest_first,
    "q2_fastest_all_ties": q2_fastest_all_ties,
    "q2_scalar_top1": q2_scalar_top1,
    "q4_periods": q4_periods,
    "q4_returners": q4_returners,
    "q5_career_wins": q5_career_wins,
    "q6_win_share": q6_win_share,
    "q6_left_join": q6_left_join,
    "q5_two_aggregates": q5_two_aggregates,
    "q5_window": q5_window,
    "q5_distinct_races": q5_distinct_races,
    "q6_lateral": q6_lateral,
    "o3_latest_race": o3_latest_race,
}
