"""Q5 and Q6: entries, wins and win share per driver (career) or per driver-season.

Both are one grouped pass with a plain count and a conditional count (G1 + G4;
the COUNT(CASE ...) form G5 is the same aggregate), the reference's "single
pass" options. One scan of results, partial aggregation before the shuffle, so a
driver with a third of all rows costs one pre-aggregated row per map task. The other
formulations of Q5 are kept as equivalence checks: two aggregates joined, and
running values over each driver (W3, W4, J15) over rows that are already counted per place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions import hundredths_of_percent, percent_text_fixed, percent_text_trimmed
from podium.operators.scan import running_sum, scan


def _wins(position: str, win_position: int):
    return F.count_if(F.col(position) == win_position)


def season_win_share(results: DataFrame, races: DataFrame, *, race: str = "RaceId",
                     driver: str = "DriverId", season: str = "RaceYear",
                     position: str = "Position", win_position: int = 1) -> DataFrame:
    """Q6 core: ``driver, season, Races, Wins, Hundredths`` (long; 8636 = 86.36%)."""
    joined = results.select(race, driver, position).join(races.select(race, season), race)
    return (joined.groupBy(driver, season)
            .agg(F.count(F.lit(1)).alias("Races"), _wins(position, win_position).alias("Wins"))
            .withColumn("Hundredths", hundredths_of_percent("Wins", "Races")))


def season_win_share_report(shares: DataFrame, drivers: DataFrame, *, driver: str = "DriverId",
                            season: str = "RaceYear", name_col) -> DataFrame:
    """Q6 output: ``Driver, Season, Races, Wins, Percentage`` ('86.36%', F6)."""
    return (shares.join(drivers, driver)
            .select(name_col.alias("Driver"), F.col(season).cast("long").alias("Season"),
                    "Races", "Wins", percent_text_fixed("Hundredths").alias("Percentage")))


def season_win_share_two_pass(results: DataFrame, races: DataFrame, *, race: str = "RaceId",
                              driver: str = "DriverId", season: str = "RaceYear",
                              position: str = "Position", win_position: int = 1) -> DataFrame:
    """Q6 option 1: races and wins as two aggregates, wins left-joined with ``coalesce``
    (J6 + F9). Kept as an equivalence check; the single pass reads results once."""
    joined = results.select(race, driver, position).join(races.select(race, season), race)
    totals = joined.groupBy(driver, season).agg(F.count(F.lit(1)).alias("Races"))
    wins = (joined.filter(F.col(position) == win_position)
            .groupBy(driver, season).agg(F.count(F.lit(1)).alias("Wins")))
    return (totals.join(wins, [driver, season], "left")
            .withColumn("Wins", F.coalesce("Wins", F.lit(0)).cast("long"))
            .withColumn("Hundredths", hundredths_of_percent("Wins", "Races")))


def career_wins(results: DataFrame, *, driver: str = "DriverId", position: str = "Position",
                win_position: int = 1, min_wins: int = 25, distinct_races: bool = False,
                race: str = "RaceId") -> DataFrame:
    """Q5 core (option 3): ``driver, Entries, Wins, Hundredths`` for drivers with
    ``Wins >= min_wins`` (P9). Entries counts result rows (trap T12), or with
    ``distinct_races`` the races entered, a race with several results once."""
    if distinct_races:
        results = results.groupBy(driver, race).agg(F.min(F.when(F.col(position) == win_position, F.col(position))).alias(position))
    return (results.groupBy(driver)
            .agg(F.count(F.lit(1)).alias("Entries"), _wins(position, win_position).alias("Wins"))
            .filter(F.col("Wins") >= min_wins)
            .withColumn("Hundredths", hundredths_of_percent("Wins", "Entries")))


def career_wins_two_aggregates(results: DataFrame, *, driver: str = "DriverId", position: str = "Position",
                               win_position: int = 1, min_wins: int = 25) -> DataFrame:
    """Q5 option 1: wins counted with ``COUNT(CASE ...)`` (G5) and entries in an aggregate of its own, joined."""
    wins = (results.groupBy(driver).agg(F.count(F.when(F.col(position) == win_position, 1)).alias("Wins"))
            .filter(F.col("Wins") >= min_wins))
    entries = results.groupBy(driver).agg(F.count(F.lit(1)).alias("Entries"))
    return wins.join(entries, driver).withColumn("Hundredths", hundredths_of_percent("Wins", "Entries"))


def career_wins_window(results: DataFrame, *, driver: str = "DriverId", position: str = "Position",
                       win_position: int = 1, min_wins: int = 25) -> DataFrame:
    """Q5 option 2: entries and wins as windows over the driver, then one row of each (W3, W4, J15). The
    running values (``scan``) go over one row per (driver, place), counted before the shuffle, and a driver's
    last row holds the whole window's; no task needs all rows of a driver, however many places there are."""
    places = results.groupBy(driver, position).agg(F.count(F.lit(1)).alias("_n"))
    places = places.withColumn("_won", F.when(F.col(position) == win_position, F.col("_n")).otherwise(0))
    running = scan(places, [driver], [position], Entries=running_sum("_n"), Wins=running_sum("_won"))
    return (running.groupBy(driver).agg(F.max("Entries").alias("Entries"), F.max("Wins").alias("Wins"))
            .filter(F.col("Wins") >= min_wins)
            .withColumn("Hundredths", hundredths_of_percent("Wins", "Entries")))


def season_win_share_lateral(results: DataFrame, races: DataFrame, *, race: str = "RaceId", driver: str = "DriverId",
                             season: str = "RaceYear", position: str = "Position", win_position: int = 1) -> DataFrame:
    """Q6 option 3: for each driver-season a correlated count in a LATERAL subquery, which Spark
    turns into a grouped join."""
    entry = results.select(F.col(race).alias("race"), F.col(driver).alias("driver"), F.col(position).alias("place")).join(
        races.select(F.col(race).alias("race"), F.col(season).alias("season")), "race")
    shares = results.sparkSession.sql(f"""
        SELECT pair.driver AS {driver}, pair.season AS {season}, tally.Races, tally.Wins
        FROM (SELECT DISTINCT driver, season FROM {{entry}}) pair,
             LATERAL (SELECT count(*) AS Races, count_if(place = {int(win_position)}) AS Wins FROM {{entry}} e
                      WHERE e.driver = pair.driver AND e.season = pair.season) tally""", entry=entry)
    return shares.withColumn("Hundredths", hundredths_of_percent("Wins", "Races"))


def career_wins_report(wins: DataFrame, periods: DataFrame, drivers: DataFrame, *,
                       driver: str = "DriverId", name_col) -> DataFrame:
    """Q5 output: ``Driver, Seasons, Entries, Wins, Percentage`` ('29.49%', '27%', F5).

    Periods are left-joined (a driver always has them when he has results)."""
    return (wins.join(drivers, driver)
            .join(periods.select(driver, "Ranges"), driver, "left")
            .select(name_col.alias("Driver"), F.col("Ranges").alias("Seasons"), "Entries",
                    "Wins", percent_text_trimmed("Hundredths").alias("Percentage")))
