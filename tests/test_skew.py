"""Hot keys: one race holds a third of all results. Broadcast joins are off and the skew thresholds low,
so each plan shows whether it aggregates or limits before the shuffle, or lets AQE split the race."""

import re

import pytest
from pyspark.sql import functions as F

from podium.operators import rules as R
from podium.operators import upsert as U
from podium.operators.completion import min_completion
from podium.operators.fastest import fastest_per_group
from podium.operators.hints import join_on_hot_key
from podium.operators.ingest import _look_up
from podium.operators.keys import group_row_number
from podium.operators.shares import career_wins_window

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    # several input files, so that a hot race's rows come from several map tasks and can be split
    rows = spark.range(0, 60_000, 1, 8).select(
        F.col("id").cast("int").alias("ResultId"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(2 + F.col("id") % 5000).cast("int").alias("RaceId"),
        (F.col("id") % 997).cast("int").alias("DriverId"), (F.col("id") % 9973).cast("int").alias("Position"),
        (F.col("id") % 501).cast("int").alias("ResultNumber"), (F.col("id") % 70).cast("int").alias("Laps"))
    races = spark.range(1, 5003).select(F.col("id").cast("int").alias("RaceId"), F.lit(2030).alias("RaceYear"))
    yield rows, races
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Initial Plan" in plan else plan


def below_exchange(plan: str, pattern: str) -> bool:
    """Some exchange of the plan has an operator matching ``pattern`` beneath it, before the next exchange."""
    parts = re.split(r"Exchange hashpartitioning", plan)[1:]
    return any(re.search(pattern, p.split("Exchange")[0]) for p in parts)


def test_control_plain_join_splits(spark, skewed):
    rows, races = skewed
    assert "skew=true" in final_plan(rows.join(races, "RaceId"))


def test_q1_join_splits(spark, skewed):
    rows, races = skewed
    drivers = spark.range(997).select(F.col("id").cast("int").alias("DriverId"), F.lit("a").alias("Firstname"), F.lit("b").alias("Lastname"))
    plan = final_plan(min_completion(rows, races, drivers, season_value=2030, threshold=0.0))
    assert "skew=true" in plan and below_exchange(plan, r"partial_max")


def test_q2_limits_before_the_shuffle(spark, skewed):
    rows, _ = skewed
    plan = final_plan(fastest_per_group(rows, group="RaceId", value="Laps", tiebreak=("ResultId",)))
    assert below_exchange(plan, r"WindowGroupLimit .*Partial")
    plan = final_plan(fastest_per_group(rows, group="RaceId", value="Laps", ties="all"))
    assert below_exchange(plan, r"partial_min")


def test_rules_count_before_the_shuffle(spark, skewed):
    rows, races = skewed
    plan = final_plan(R.unique_violations(R.driver_rule(), rows, races=races))
    assert below_exchange(plan, r"partial_count")
    # the gate's join comes after the count
    assert plan.index("SortMergeJoin") < plan.index("partial_count")


def test_creates_split_or_reduce(spark, skewed):
    rows, races = skewed
    batch = rows.withColumn("ResultId", F.col("ResultId") + 1_000_000).withColumn("Position", F.lit(1)).withColumn("seq", F.col("ResultId"))
    report = U.create_unique(rows, batch, races, R.position_rule())
    plan = final_plan(report)
    assert "skew=true" in plan and below_exchange(plan, r"WindowGroupLimit .*Partial")
    assert report.count() == 60_000
    owned = U.create_owned(rows, batch.withColumn("ResultNumber", F.lit(7)), races, R.number_owner_rule())
    assert "skew=true" in final_plan(owned)


def test_null_keys_are_not_joined(spark, skewed):
    rows, races = skewed
    batch = (rows.withColumn("ResultId", F.col("ResultId") + 1_000_000).withColumn("seq", F.col("ResultId"))
             .withColumn("Position", F.lit(None).cast("int")))
    report = U.create_unique(rows, batch, races, R.position_rule())
    assert report.filter("Status = 'accepted'").count() == 60_000


def test_hot_key_join_of_two_types(spark):
    """Keys of different widths meet as in a plain join."""
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k long, w string")
    got = join_on_hot_key(left, right, "k", "left").select("k", "v", "w").collect()
    assert sorted(map(str, got)) == sorted(map(str, left.join(right, "k", "left").select("k", "v", "w").collect()))


HOT_RACE_JOINS = {
    "group_row_number": lambda rows, races: group_row_number(rows, ["RaceId"], ["ResultId"]),
    "ingest_look_up": lambda rows, races: _look_up(rows, races, ["RaceId"]),
}


@pytest.mark.parametrize("name", sorted(HOT_RACE_JOINS))
def test_joins_of_keys_and_ingest_split_a_hot_race(spark, skewed, name):
    """The join on the race is split by AQE, where a plain join after an aggregate on the race is not."""
    rows, races = skewed
    plan = final_plan(HOT_RACE_JOINS[name](rows, races.groupBy("RaceId").agg(F.min("RaceYear").alias("RaceYear"))))
    assert "skew=true" in plan
    control = final_plan(rows.join(rows.groupBy("RaceId").agg(F.min("ResultId").alias("first")), "RaceId"))
    assert "skew=true" not in control


def test_windows_over_a_hot_group_are_spread(spark, skewed):
    """Q1's and Q5's window forms: no window takes a whole race or driver, and the answers are the grouped forms'."""
    rows, races = skewed
    drivers = spark.range(997).select(F.col("id").cast("int").alias("DriverId"), F.lit("a").alias("Firstname"), F.col("id").cast("string").alias("Lastname"))
    q1 = {m: sorted(map(str, min_completion(rows, races, drivers, season_value=2030, threshold=0.0, method=m).collect())) for m in ("window", "aggregate")}
    assert q1["window"] == q1["aggregate"]
    for plan in (final_plan(min_completion(rows, races, drivers, season_value=2030, threshold=0.0, method="window")),
                 final_plan(career_wins_window(rows.withColumn("DriverId", F.col("RaceId")), min_wins=0))):
        assert "Window [" in plan and all("_part" in line.split("Window [")[1] for line in plan.splitlines() if "Window [" in line and "Group" not in line)
