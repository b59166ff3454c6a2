"""S14 publish-or-reject, S7 append, S11/S13 layouts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from podium.operators import rules as R
from podium.sources.sinks import (
    ConstraintViolation, append, materialize, publish, save_bucketed, shared_folder, write_range_clustered,
)
from tests.helpers import races, results


def _fresh(spark):
    return shared_folder(spark, f"test-sinks/{uuid.uuid4().hex}")


def test_publish_writes_only_clean_snapshots(spark):
    race = races(spark, [(900000, 2030)])
    good = results(spark, [(1, 900000, 7, 1), (2, 900000, 8, 2)])
    bad = good.unionByName(results(spark, [(3, 900000, 9, 1)]))
    rule = R.position_rule()
    target = _fresh(spark)
    assert publish(good, {"R1": R.violations(rule, R.with_season(good, race))}, target, dry_run=True) is None
    assert not os.path.exists(target.replace("file:", ""))
    with pytest.raises(ConstraintViolation) as err:
        publish(bad, {"R1": R.violations(rule, R.with_season(bad, race))}, target)
    assert "Duplicate position detected: RaceId = 900000, Position = 1, Count = 2" in str(err.value)
    assert publish(good, {"R1": R.violations(rule, R.with_season(good, race))}, target) == target
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(Exception):           # a published snapshot is never overwritten
        publish(good, {}, target)


def test_append_and_materialize(spark):
    target = _fresh(spark)
    df = results(spark, [(1, 900000, 7, 1)])
    append(df, target)
    append(df, target)
    assert spark.read.parquet(target).count() == 2
    assert materialize(df, "test-sinks-mat").count() == 1


def test_layouts(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).alias("RaceId"), (F.col("id") % 11).alias("DriverId"),
                                     F.col("id").cast("double").alias("FastestLapTime"))
    name = f"t_bucketed_{uuid.uuid4().hex[:8]}"
    save_bucketed(df, name, bucket_by=["RaceId"], sort_by=["RaceId", "DriverId"], buckets=4)
    agg = spark.table(name).groupBy("RaceId").count()
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan          # S11: grouping on the bucket key needs no shuffle
    path = _fresh(spark)
    write_range_clustered(df, path, cluster_by=["RaceId"], sort_by=["RaceId", "FastestLapTime"], partitions=4)
    files = [f for f in os.listdir(path.replace("file:", "")) if f.endswith(".parquet")]
    assert len(files) == 4
    assert spark.read.parquet(path).filter("RaceId = 5").count() == df.filter("RaceId = 5").count()


def test_update_where_and_sql_views(spark):
    """S9 with a predicate (no join), and the tables exposed to spark.sql."""
    from podium.operators.overlay import update_where
    from podium.sources.tables import read_tables
    from tests.conftest import SF_SMALL

    base = results(spark, [(1, 900000, 7, 2), (2, 900000, 8, 3)])
    out = update_where(base, F.col("ResultId") == 2, {"Position": F.lit(5)})
    assert sorted((r["ResultId"], r["Position"]) for r in out.collect()) == [(1, 2), (2, 5)]
    read_tables(spark, SF_SMALL).register_views(["orders"])
    assert spark.sql("SELECT count(*) AS n FROM orders").first()["n"] == spark.read.parquet(
        f"{SF_SMALL}/orders.parquet").count()


def test_apply_and_publish(spark):
    """SURVEY 3.2: updates that keep every rule publish; one that breaks R1 publishes nothing."""
    from podium.plans.publish_job import apply_and_publish

    race = races(spark, [(900000, 2030)])
    base = results(spark, [(1, 900000, 7, 1, 44), (2, 900000, 8, 2, 33)])
    rules = [R.position_rule(), R.driver_rule(), R.number_owner_rule()]
    ok_target = _fresh(spark)
    fine = results(spark, [(2, 900000, 8, 3, 33)])
    assert apply_and_publish(base, fine, race, rules, ok_target) == ok_target
    assert sorted(r["Position"] for r in spark.read.parquet(ok_target).collect()) == [1, 3]
    bad_target = _fresh(spark)
    clash = results(spark, [(2, 900000, 8, 1, 33)])
    with pytest.raises(ConstraintViolation) as err:
        apply_and_publish(base, clash, race, rules, bad_target, columns=["Position"])
    assert err.value.name == "R1"
    assert not os.path.exists(bad_target.replace("file:", ""))
    new_row = results(spark, [(3, 900000, 9, 4, 44)])
    with pytest.raises(ConstraintViolation) as err:
        apply_and_publish(base, new_row, race, rules, _fresh(spark), insert=True)
    assert err.value.name == "R4"


def test_stored_table_rebuilds_on_changed_inputs(spark):
    """Derived tables are reused for the same inputs and rebuilt when an input changes."""
    from podium.sources.sinks import input_fingerprint, stored_table

    src = _fresh(spark)
    spark.range(5).write.parquet(src)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(src).selectExpr("count(*) AS n")

    fp1 = input_fingerprint(spark, [src], "v1")
    assert stored_table(spark, "t_stored", fp1, build).first()["n"] == 5
    assert stored_table(spark, "t_stored", fp1, build).first()["n"] == 5
    assert len(calls) == 1                                   # second call read the stored copy
    spark.range(3).write.mode("append").parquet(src)         # the input changes
    fp2 = input_fingerprint(spark, [src], "v1")
    assert fp2 != fp1 and input_fingerprint(spark, [src], "v2") != fp2   # code changes count too
    assert stored_table(spark, "t_stored", fp2, build).first()["n"] == 8
    assert len(calls) == 2
