"""Periods and standings continued from what is stored, instead of rebuilt (S10, Q4, 2.16).

A batch brings new seasons of drivers or new rounds of seasons. Only the drivers and seasons it names are
read and computed; the results say what to put in place of their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.operators.hints import join_on_hot_key
from podium.operators.standings import rank_in_round


def continue_periods(islands: DataFrame, pairs: DataFrame, *, driver: str = "DriverId", season: str = "RaceYear") -> DataFrame:
    """``driver, FromYear, ToYear`` of the drivers that ``pairs`` names: their stored islands united with the
    new seasons.

    islands: ``season_islands`` so far (any intervals do; overlapping ones unite). pairs: new (driver, season) rows, which may repeat,
    be known already or lie between stored seasons; NULLs are left out. Adjacent and overlapping intervals become one: ordered
    by their start, one begins a new island where it starts more than a year after all before it ended. The window
    holds one driver's islands and new seasons, which the number of seasons bounds.
    """
    fresh = pairs.select(driver, season).where(F.col(driver).isNotNull() & F.col(season).isNotNull()).distinct()
    known = islands.join(fresh.select(driver).distinct(), driver, "left_semi").select(driver, "FromYear", "ToYear")
    parts = known.unionByName(fresh.select(driver, F.col(season).alias("FromYear"), F.col(season).alias("ToYear")))
    ordered = Window.partitionBy(driver).orderBy("FromYear", "ToYear")
    reached = F.max("ToYear").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("FromYear") <= F.col("_reached") + 1, 0).otherwise(1)
    numbered = parts.withColumn("_reached", reached).withColumn("_nr", F.sum(first).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(driver, "_nr").agg(F.min("FromYear").alias("FromYear"), F.max("ToYear").alias("ToYear")).drop("_nr")


def in_place(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of each ``key`` that ``changed`` names replaced by those of ``changed``."""
    kept = stored.join(changed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changed.select(*[F.col(c).cast(stored.schema[c].dataType) for c in stored.columns]))


def continue_standings(standings: DataFrame, races: DataFrame, round_points: DataFrame, new_races: DataFrame, *,
                       race: str = "RaceId", season: str = "RaceYear", round_: str = "NrOfRound", entity: str = "DriverId",
                       points: str = "Points", position: str = "Position") -> DataFrame:
    """Standings rows ``race, entity, points, position`` that new rounds add or change.

    standings, races: stored so far (``build_standings``), of which only the seasons of ``new_races`` are read.
    new_races: races that come after all stored rounds of their season. round_points: points of these races per
    (race, entity), sparse, may repeat.

    The new rounds start from each competitor's points after the season's last stored round, so no earlier result is
    read. A competitor new to a running season stands there with 0 points in its earlier rounds too,
    as in a rebuild, so these rounds are ranked again for that season only. A race with no standings yet (nobody has
    scored) is dealt with like a stored one.
    """
    seasons = new_races.select(season).distinct()
    old_calendar = races.select(race, season, round_).join(seasons, season, "left_semi")
    calendar = new_races.select(race, season, round_)
    acc = standings.schema[points].dataType
    stored = standings.join(old_calendar, race).select(season, round_, race, entity, F.col(points).cast(acc).alias("_cum"))
    # points after the last stored round, and those of the new ones
    base = stored.groupBy(season, entity).agg(F.max_by("_cum", round_).alias("_base"))
    gained = (round_points.select(race, entity, points).join(calendar, race)
              .groupBy(season, entity, round_).agg(F.sum(F.col(points).cast(acc)).cast(acc).alias("_p")))
    scored = gained.groupBy(season, entity).agg(F.map_from_entries(F.collect_list(F.struct(round_, F.coalesce("_p", F.lit(0).cast(acc))))).alias("_by_round"))
    field = base.join(scored, [season, entity], "full_outer")
    ahead = calendar.groupBy(season).agg(F.array_sort(F.collect_list(F.struct(round_, race))).alias("_rounds"))
    behind = old_calendar.groupBy(season).agg(F.collect_list(race).alias("_earlier"))
    field = join_on_hot_key(field, ahead.join(behind, season, "left"), season)
    zero = F.lit(0).cast(acc)
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("race", races.schema[race].dataType), T.StructField("cum", acc)])))

    def step(done, now):
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["cum"], F.col("_base"), zero)
        here = (before + F.coalesce(F.try_element_at("_by_round", now[round_]), zero)).cast(acc)
        return F.concat(done, F.array(F.struct(now[race].cast(races.schema[race].dataType).alias("race"), here.alias("cum"))))
    coming = F.aggregate("_rounds", none, step)
    earlier = F.transform(F.coalesce("_earlier", F.array().cast(T.ArrayType(races.schema[race].dataType))),
                          lambda r: F.struct(r.alias("race"), zero.alias("cum")))
    newcomer = F.col("_base").isNull()
    rows = (field.select(season, entity, newcomer.alias("_new"), F.explode(F.when(newcomer, F.concat(earlier, coming)).otherwise(coming)).alias("_z"))
            .select(season, entity, "_new", F.col("_z.race").alias(race), F.col("_z.cum").alias("_cum")))
    again = field.where(newcomer).select(season).distinct()
    whole = rows.select(race, entity, "_cum").unionByName(stored.join(again, season, "left_semi").select(race, entity, "_cum"))
    ranked = rank_in_round(whole, race=race, points="_cum", entity=entity, out=position)
    return ranked.select(race, entity, F.col("_cum").alias(points), position)
