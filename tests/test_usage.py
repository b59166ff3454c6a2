"""The README's usage example on tiny tables with the racing schema's own column names."""

import datetime as dt
import os

from podium.functions import full_name
from podium.operators import rules as R
from podium.operators import upsert as U
from podium.operators.completion import min_completion
from podium.operators.fastest import fastest_per_group
from podium.operators.periods import active_periods, driver_seasons, periods_report
from podium.operators.standings import build_standings, final_standings, season_champions
from podium.plans.publish_job import apply_and_publish
from podium.sources.sinks import shared_folder


def test_readme_usage(spark):
    race = spark.createDataFrame(
        [(1, 2021, 1, dt.date(2021, 3, 28), "Bahrain", 10), (2, 2021, 2, dt.date(2021, 4, 18), "Imola", 11),
         (3, 2024, 1, dt.date(2024, 3, 2), "Bahrain", 10), (4, 2019, 1, dt.date(2019, 3, 31), "Bahrain", 10)],
        "RaceId int, RaceYear int, NrOfRound int, RaceDate date, RaceName string, CircuitId int")
    result = spark.createDataFrame(
        [(1, 1, 33, 9, 1, 56, 92.1, 33), (2, 1, 44, 131, 2, 56, 91.9, 44), (3, 2, 33, 9, 2, 63, 90.0, 33),
         (4, 2, 44, 131, 1, 63, 90.5, 44), (5, 3, 33, 9, 1, 57, 93.0, 1), (6, 3, 16, 6, 2, 55, 92.5, 16),
         (7, 4, 44, 131, 1, 57, 94.0, 44)],
        "ResultId int, RaceId int, DriverId int, ConstructorId int, Position int, Laps int, "
        "FastestLapTime double, ResultNumber int")
    driver = spark.createDataFrame([(33, "Max", "Verstappen"), (44, "Lewis", "Hamilton"), (16, "Charles", "Leclerc")],
                                   "DriverId int, Firstname string, Lastname string")
    standing = build_standings(result.select("RaceId", "DriverId", F_points(result)), race)

    q1 = {r["Name"]: r["Completion"] for r in min_completion(result, race, driver, season_value=2024).collect()}
    assert q1 == {"Max Verstappen": "100%", "Charles Leclerc": "96%"}   # 55 of 57 laps
    in_window = race.filter("RaceYear BETWEEN 2004 AND 2024").select("RaceId")
    q2 = fastest_per_group(result.join(in_window, "RaceId", "left_semi"), group="RaceId",
                           value="FastestLapTime", tiebreak=["ResultId"])
    assert sorted((r["RaceId"], r["DriverId"]) for r in q2.collect()) == [(1, 44), (2, 33), (3, 16), (4, 44)]
    periods = active_periods(driver_seasons(result, race))
    q4 = {r["Coureur"]: r["Periodes"] for r in periods_report(
        periods, driver, name_col=full_name("Firstname", "Lastname"), min_periods=2).collect()}
    assert q4 == {"Max Verstappen": "2021, 2024", "Lewis Hamilton": "2019, 2021"}
    q3 = {r["RaceYear"]: (r["DriverId"], r["RaceWins"]) for r in
          season_champions(standing, race, result, seasons=(2015, 2024)).collect()}
    assert q3 == {2019: (44, 1), 2021: (33, 1), 2024: (33, 1)}   # 2021: 43-43, id breaks the tie
    q7 = {r["DriverId"]: (r["Position"], r["ConstructorId"]) for r in
          final_standings(standing, race, result, seasons=[2021], constructor="ConstructorId").collect()}
    assert q7 == {33: (1, 9), 44: (2, 131)}
    batch = result.limit(0).withColumn("seq", result["ResultId"])
    assert U.create_with_rules(result, batch, race, [R.position_rule(), R.driver_rule()]).count() == 0
    target = shared_folder(spark, f"usage/{os.getpid()}-{id(race)}")
    changes = result.filter("ResultId = 6").withColumn("Position", result["Position"] + 1)
    assert apply_and_publish(result, changes, race, [R.position_rule()], target) == target


def F_points(result):
    from pyspark.sql import functions as F

    # points per result: 25 for a win, 18 otherwise
    return F.when(F.col("Position") == 1, F.lit(25.0)).otherwise(F.lit(18.0)).alias("Points")
