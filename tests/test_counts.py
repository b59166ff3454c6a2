"""Counts kept by signed changes against a full audit, and that a check reads no base."""

import random

from pyspark.sql import functions as F

from podium.operators import rules as R
from podium.operators.counts import MERGED, RuleCounts
from podium.sources.sinks import fresh_folder
from podium.sources.snapshots import Snapshots
from tests.helpers import RACE_DDL, RESULT_DDL, races, results

RULES = [R.position_rule(), R.driver_rule(), R.season_cap_rule(3), R.number_owner_rule()]


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def audit(rule, state, race):
    if isinstance(rule, R.OwnerRule):
        return R.violations(rule, R.with_season(state, race))
    return R.violations(rule, race) if isinstance(rule, R.CapRule) else R.violations(rule, state, races=race)


def random_rows(r, first, n):
    return [(first + i, r.randrange(30), r.randrange(6), r.choice([None, 1, 2, 3, 4]), r.choice([None, 5, 6, 7])) for i in range(n)]


def test_random_batches_equal_the_audit(spark):
    r = random.Random(4)
    seasons = {i: r.choice([1950, 1990, 2020, 2021, 2022]) for i in range(30)}
    race = races(spark, list(seasons.items()))
    state = {row[0]: row for row in random_rows(r, 0, 120)}
    counts = RuleCounts(Snapshots(spark, fresh_folder(spark, "test-counts")), RULES)
    counts.build(results(spark, list(state.values())), race)
    for b in range(MERGED + 2):
        gone = [state.pop(k) for k in r.sample(sorted(state), 15)]
        # some come back elsewhere, as an update does, and new ones arrive
        come = [(k[0], *random_rows(r, 0, 1)[0][1:]) for k in gone[:10]] + random_rows(r, 1000 * (b + 1), 8)
        state.update({row[0]: row for row in come})
        came = results(spark, come)
        counts.apply(race, added={"results": came}, removed={"results": results(spark, gone)})
        if b in (1, MERGED - 1, MERGED + 1):
            now = results(spark, list(state.values()))
            for rule in RULES:
                assert rows_of(counts.violations(rule.name)) == rows_of(audit(rule, now, race))
            touched = R.with_season(came, race)
            for rule in RULES[:2]:
                assert rows_of(counts.violations(rule.name, came)) == rows_of(R.violations(rule, now, came, races=race))
            assert rows_of(counts.violations("R4", touched)) == rows_of(R.violations(RULES[3], R.with_season(now, race), touched))
    parts = counts.store._state(counts.store.version())["R1"]["parts"]
    assert len(parts) < MERGED  # merged on the way


def test_races_come_and_go(spark):
    counts = RuleCounts(Snapshots(spark, fresh_folder(spark, "test-counts")), [RULES[2]])
    race = races(spark, [(i, 2020) for i in range(3)])
    counts.build(results(spark, []), race)
    assert counts.violations("R3").count() == 0
    fourth = spark.createDataFrame(race.withColumn("RaceId", F.lit(9)).limit(1).collect(), RACE_DDL)
    counts.apply(race, added={"races": fourth})
    assert [(x.RaceYear, x.Count) for x in counts.violations("R3", fourth).collect()] == [(2020, 4)]
    counts.apply(race, removed={"races": fourth})
    assert counts.violations("R3").count() == 0
    assert counts.counts("R3", spark.createDataFrame([], "RaceYear int")).count() == 0


def test_a_check_reads_counts_near_the_batch_and_no_base(spark):
    """Results of 2,000 races in several files: the check of a batch in one race opens the counts' files of that race."""
    base = fresh_folder(spark, "test-counts-base")
    spark.range(40_000).select(F.col("id").cast("int").alias("ResultId"), (F.col("id") % 2000).cast("int").alias("RaceId"), (F.col("id") % 977).cast("int").alias("DriverId"),
                               (F.col("id") % 31).cast("int").alias("Position"), F.lit(None).cast("int").alias("ResultNumber")).write.parquet(base)
    race = spark.range(2000).select(F.col("id").cast("int").alias("RaceId"), F.lit(2020).alias("RaceYear"))
    counts = RuleCounts(Snapshots(spark, fresh_folder(spark, "test-counts")), [RULES[0]])
    counts.build(spark.read.parquet(base), race)
    batch = spark.createDataFrame([(90_000, 7, 1, 7, None)], RESULT_DDL)
    counts.apply(race, added={"results": batch})
    check = counts.violations("R1", batch)
    assert [(x.RaceId, x.Position, x.Count) for x in check.collect()] == [(7, 7, 2)]
    assert not any(base in f for f in check.inputFiles())
    assert len(check.inputFiles()) < len(counts.store.files("R1"))
