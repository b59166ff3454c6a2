"""Active periods per driver as gaps-and-islands over seasons.

``'1991-2006, 2010-2012'``: consecutive seasons form one island, islands are
listed in season order (trap T8: the order is fixed inside the aggregate; the
reference's ``ORDER BY ... OFFSET 0 ROWS`` inside a CTE (O6) has no meaning in
Spark and is dropped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import year_range
from podium.operators.scan import previous, running_sum, scan


def driver_seasons(results: DataFrame, races: DataFrame, *, race: str = "RaceId",
                   driver: str = "DriverId", season: str = "RaceYear") -> DataFrame:
    """Distinct (driver, season) pairs (G9). The distinct is aggregated map-side,
    so even a driver with a third of all results yields one row per season."""
    return (results.select(race, driver).join(races.select(race, season), race)
            .select(driver, season).distinct())


def season_islands(pairs: DataFrame, *, driver: str = "DriverId", season: str = "RaceYear",
                   method: str = "rank") -> DataFrame:
    """One row per island: ``driver, FromYear, ToYear``.

    rank (default): ``season - row_number()`` is constant inside a run of
    consecutive seasons. lag (the view's own form, W5 + W6 + F20): a new-island
    flag from ``lag(season) + 1 = season`` and its running sum. The reference runs
    that sum over the whole table in one ordered pass; here it is partitioned by
    driver, which gives the same islands because islands never cross drivers.
    Either window holds one driver's distinct seasons - bounded by the number of
    seasons, whatever the driver's result count.
    """
    w = Window.partitionBy(driver).orderBy(season)
    if method == "rank":
        keyed = pairs.withColumn("_grp", F.col(season) - F.row_number().over(w))
    elif method == "lag":
        new_island = F.when(F.lag(season, 1).over(w) + 1 == F.col(season), 0).otherwise(1)
        running = Window.partitionBy(driver).orderBy(season).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        keyed = (pairs.withColumn("_new", new_island)
                 .withColumn("_grp", F.sum("_new").over(running)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return (keyed.groupBy(driver, "_grp")
            .agg(F.min(season).alias("FromYear"), F.max(season).alias("ToYear"))
            .drop("_grp"))


def numbered_islands(pairs: DataFrame, *, driver: str = "DriverId", season: str = "RaceYear") -> DataFrame:
    """``driver, FromYear, ToYear, Island``: the view's own form, one ordered pass over the whole table (W6): LAG gives the
    row before, and the running sum of the new-island flags numbers all islands from 1 on, by driver and season.
    An unpartitioned window would sort the table in one task; ``scan`` spreads it. pairs: distinct, without NULLs."""
    before = scan(pairs, [], [driver, season], _driver=previous(driver), _season=previous(season))
    new = F.when((F.col("_driver") == F.col(driver)) & (F.col("_season") + 1 == F.col(season)), 0).otherwise(1)
    numbered = scan(before.withColumn("_new", new), [], [driver, season], Island=running_sum("_new"))
    return numbered.groupBy("Island").agg(F.first(driver).alias(driver), F.min(season).alias("FromYear"), F.max(season).alias("ToYear"))


def active_periods(pairs: DataFrame, *, driver: str = "DriverId", season: str = "RaceYear",
                   sep: str = ", ", dash: str = "-", method: str = "rank") -> DataFrame:
    """The DriverYearRanges view: ``driver, Ranges, Periods`` from (driver, season) rows.

    ``pairs`` may repeat a pair (one row per result); it is made distinct (G9)
    map-side first. G10: ordered ``listagg`` over the driver's islands, a list
    bounded by the number of seasons.
    """
    distinct_pairs = pairs.select(driver, season).distinct()
    islands = season_islands(distinct_pairs, driver=driver, season=season, method=method)
    return listed_periods(islands, driver=driver, sep=sep, dash=dash)


def listed_periods(islands: DataFrame, *, driver: str = "DriverId", sep: str = ", ", dash: str = "-") -> DataFrame:
    """``driver, Ranges, Periods`` from ``season_islands`` rows."""
    ranged = islands.withColumn("_range", year_range("FromYear", "ToYear", dash))
    sep_sql = sep.replace("'", "''")
    return ranged.groupBy(driver).agg(
        F.expr(f"listagg(_range, '{sep_sql}') WITHIN GROUP (ORDER BY FromYear)").alias("Ranges"),
        F.count(F.lit(1)).alias("Periods"),
    )


def periods_report(periods: DataFrame, drivers: DataFrame, *, driver: str = "DriverId",
                   name_col, min_periods: int = 1) -> DataFrame:
    """Q4 options 1/2: ``Coureur, Periodes``; ``min_periods=2`` keeps returners only.

    The island count replaces option 2's ``LIKE '%,%'`` test (P6) - same rows,
    no string scan.
    """
    kept = periods if min_periods <= 1 else periods.filter(F.col("Periods") >= min_periods)
    return (kept.join(drivers, driver)
            .select(name_col.alias("Coureur"), F.col("Ranges").alias("Periodes")))
