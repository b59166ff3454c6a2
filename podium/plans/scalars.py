"""Registered queries that isolate single operators of SURVEY section 2 on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import (
    full_name, hundredths_of_percent, nth_part, percent_text_fixed, percent_text_trimmed,
)
from podium.operators.continuation import continue_periods, in_place
from podium.operators.exists import exists_between, exists_where
from podium.operators.periods import active_periods, listed_periods, numbered_islands, periods_report, season_islands
from podium.plans import model
from podium.sources.sinks import materialize
from podium.sources.tables import read_tables


def w5_w6_periods_lag(spark: SparkSession, root: str) -> DataFrame:
    """W5 + W6 + F20: Q4 periods built the view's way - LAG gap flag and a running
    sum (partitioned by driver, not one global ordered pass)."""
    t = read_tables(spark, root)
    pairs = model.race(t).select(F.col("CustomerId").alias("DriverId"), "RaceYear")
    return periods_report(active_periods(pairs, method="lag"), model.customer_driver(t),
                          name_col=full_name("Firstname", "Lastname"))


def q4_continued_periods(spark: SparkSession, root: str) -> DataFrame:
    """Q4 on stored islands that are continued: all seasons but the last two are stored, these come as a batch."""
    t = read_tables(spark, root)
    pairs = model.race(t).select(F.col("CustomerId").alias("DriverId"), "RaceYear")
    last = pairs.agg(F.max("RaceYear")).first()[0] or 0
    stored = materialize(season_islands(pairs.where(F.col("RaceYear") < last - 1).distinct()), "islands")
    changed = continue_periods(stored, pairs.where(F.col("RaceYear") >= last - 1))
    periods = listed_periods(in_place(stored, materialize(changed, "islands_changed"), "DriverId"))
    return periods_report(periods, model.customer_driver(t), name_col=full_name("Firstname", "Lastname"))


def j8_exists_other(spark: SparkSession, root: str) -> DataFrame:
    """Results whose number another driver of the same race has too (EXISTS with ``<>``)."""
    rows = model.result(read_tables(spark, root)).select("RaceId", "DriverId", F.expr("ResultNumber % 20").alias("Number"), "PartId")
    return exists_where(rows, rows.select("RaceId", "Number", "DriverId"), ["RaceId", "Number"], "DriverId", "<>", "DriverId")


def j10_no_later_race(spark: SparkSession, root: str) -> DataFrame:
    """A competitor's last races of a season (NOT EXISTS with ``<``)."""
    rows = model.race(read_tables(spark, root)).select("CustomerId", "RaceYear", "RaceDate", "RaceId")
    last = exists_where(rows, rows, ["CustomerId", "RaceYear"], "RaceDate", "<", "RaceDate", anti=True)
    return last.select("RaceId", "CustomerId", F.col("RaceDate").cast("string").alias("RaceDate"))


def j10_again_within(spark: SparkSession, root: str) -> DataFrame:
    """J10 with a range: races that the competitor follows up within 30 days (EXISTS with BETWEEN)."""
    rows = model.race(read_tables(spark, root)).select("CustomerId", "RaceDate", "RaceId")
    soon = exists_between(rows, rows, "CustomerId", F.date_add("RaceDate", 1), F.date_add("RaceDate", 30), "RaceDate")
    return soon.select("RaceId", "CustomerId", F.col("RaceDate").cast("string").alias("RaceDate"))


def w6_global_islands(spark: SparkSession, root: str) -> DataFrame:
    """W5 + W6 over the whole table, not per driver: all periods numbered in one ordered pass."""
    pairs = model.race(read_tables(spark, root)).select(F.col("CustomerId").alias("DriverId"), "RaceYear").distinct()
    return numbered_islands(pairs).select("DriverId", *[F.col(c).cast("long").alias(c) for c in ("FromYear", "ToYear", "Island")])


def f12_name_split(spark: SparkSession, root: str) -> DataFrame:
    """split full names at the first space (one-word names get an empty last name)."""
    return model.part_driver(read_tables(spark, root))


def f15_nth_part(spark: SparkSession, root: str) -> DataFrame:
    """N-th field of a delimited text, NULL when out of range (not '')."""
    o = read_tables(spark, root).orders
    return o.select(F.col("o_orderkey").alias("OrderId"),
                    nth_part("o_orderpriority", "-", 1).alias("Part1"),
                    nth_part("o_orderpriority", "-", 2).alias("Part2"),
                    nth_part("o_orderpriority", "-", 3).alias("Part3"))


def f5_f6_percent_text(spark: SparkSession, root: str) -> DataFrame:
    """F5/F6/F8/F10 + G4: share of a customer's orders that are finished, as
    '27%' / '29.49%' (trimmed) and '27.00%' (fixed)."""
    o = read_tables(spark, root).orders
    agg = (o.groupBy(F.col("o_custkey").alias("CustomerId"))
           .agg(F.count(F.lit(1)).alias("Orders"),
                F.count_if(F.col("o_orderstatus") == "F").alias("Finished"))
           .withColumn("_h", hundredths_of_percent("Finished", "Orders")))
    return agg.select("CustomerId", F.col("Orders").cast("long").alias("Orders"),
                      F.col("Finished").cast("long").alias("Finished"),
                      percent_text_trimmed("_h").alias("Trimmed"), percent_text_fixed("_h").alias("Fixed"))


def j13_lateral_count(spark: SparkSession, root: str) -> DataFrame:
    """Per race the number of results - CROSS APPLY of a COUNT keeps races with
    none (0), so pre-aggregate, LEFT join and coalesce."""
    t = read_tables(spark, root)
    counts = model.result(t).groupBy("RaceId").agg(F.count(F.lit(1)).alias("Results"))
    return (model.race(t).select("RaceId").join(counts, "RaceId", "left")
            .select("RaceId", F.coalesce("Results", F.lit(0)).cast("long").alias("Results")))


def j9_anti(spark: SparkSession, root: str) -> DataFrame:
    """Races without any result (NOT EXISTS as a left anti join). The race ids are made
    distinct on the scan's side first, so a race with many results is one row."""
    t = read_tables(spark, root)
    return (model.race(t).join(model.result(t).select("RaceId").distinct(), "RaceId", "left_anti")
            .select("RaceId", F.col("RaceYear").cast("long").alias("RaceYear")))


QUERIES = {
    "w5_w6_periods_lag": w5_w6_periods_lag,
    "q4_continued_periods": q4_continued_periods,
    "w6_global_islands": w6_global_islands,
    "j8_exists_other": j8_exists_other,
    "j10_no_later_race": j10_no_later_race,
    "j10_again_within": j10_again_within,
    "f12_name_split": f12_name_split,
    "f15_nth_part": f15_nth_part,
    "f5_f6_percent_text": f5_f6_percent_text,
    "j13_lateral_count": j13_lateral_count,
    "j9_anti": j9_anti,
}
