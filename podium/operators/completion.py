"""Q1: drivers whose lowest race completion in a season reaches a threshold.

Race length is inferred as the most laps anyone completed in that race (the
reference's stated assumption). "Completed every race" means every race the
driver entered, so one-race drivers qualify (trap T6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions import full_name, whole_percent
from podium.operators.hints import join_on_hot_key
from podium.operators.scan import running_max, scan


def _season_results(results, races, race, driver, laps, season, season_value):
    # P2 + J7: keep the season's races only; a semi-join never multiplies rows.
    season_races = races.filter(F.col(season) == season_value).select(race)
    return results.select(race, driver, laps).join(season_races, race, "left_semi")


def min_completion(results: DataFrame, races: DataFrame, drivers: DataFrame, *,
                   season_value: int, threshold: float = 0.9, min_entries: int = 1, method: str = "aggregate",
                   race: str = "RaceId", driver: str = "DriverId", laps: str = "Laps",
                   season: str = "RaceYear", first: str = "Firstname", last: str = "Lastname",
                   name: str = "Name") -> DataFrame:
    """Q1 (options 1-3). Output: ``Name``, ``Completion`` ('98%'), ``MinCompletion``.

    min_entries: races a driver must have entered (1 lets one-race drivers qualify).
    ``method="aggregate"`` (default, options 1/3): per-race ``max(laps)`` is a
    partial aggregate straight on the results; the season's races pick their maxima (one
    row per race), and the results join these once, in a join that AQE can split for a race
    with many rows.
    ``method="window"`` (option 2, W1): ``max(laps) OVER (PARTITION BY race)`` without a join, as the running
    maximum of the race's results from most to fewest laps (``scan``), so a race with many rows lies in several
    tasks. It sorts the season's results, so the other method is the cheaper one.
    """
    if method == "window":
        r = _season_results(results, races, race, driver, laps, season, season_value)
        per = scan(r, [race], [F.col(laps).desc_nulls_last(), driver], _max_laps=running_max(laps))
    elif method == "aggregate":
        r = results.select(race, driver, laps)
        season_races = races.filter(F.col(season) == season_value).select(race).distinct()
        race_laps = r.groupBy(race).agg(F.max(laps).alias("_max_laps")).join(season_races, race)
        per = join_on_hot_key(r, race_laps, race)
    else:
        raise ValueError(f"unknown method {method!r}")
    # P11 + T19: a race whose max laps is 0 has no completion (NULL), not an error.
    ratio = F.col(laps).cast("double") / F.nullif(F.col("_max_laps").cast("double"), F.lit(0.0))
    per_driver = (per.groupBy(driver)
                  .agg(F.min(ratio).alias("MinCompletion"),
                       # rounding is monotone, so min of rounded = rounded min
                       F.min(whole_percent(laps, "_max_laps")).alias("_pct"), F.count(F.lit(1)).alias("_entries")))
    qualified = per_driver.filter((F.col("MinCompletion") >= threshold) & (F.col("_entries") >= min_entries))  # P9 HAVING
    return (qualified.join(drivers.select(driver, first, last), driver)
            .select(full_name(first, last).alias(name),
                    F.concat(F.col("_pct").cast("string"), F.lit("%")).alias("Completion"),
                    "MinCompletion"))
