"""Keyed updates of single files, and several tables that appear together or not at all."""

import uuid

import pytest
from pyspark.sql import functions as F

from podium.sources import snapshots
from podium.sources.clustering import CURVE, along_curve
from podium.sources.sinks import ConstraintViolation, shared_folder
from podium.sources.snapshots import Snapshots, VersionConflict

FILES = 40


@pytest.fixture()
def store(spark):
    return Snapshots(spark, shared_folder(spark, f"test-snapshots/{uuid.uuid4().hex}"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def table(spark, store):
    df = spark.range(0, 4000).select("id", (F.col("id") % 7).alias("race"), F.lit("old").alias("state"))
    store.create({"T": df}, cluster={"T": ["id"]}, files=FILES)
    return store


def applied(rows, changes, columns=("race", "state")):
    """The table after the changes, one after the other."""
    state = {r[0]: dict(zip(("race", "state"), r[1:])) for r in rows}
    for key, race, new in changes:
        if key in state:
            state[key].update({c: v for c, v in (("race", race), ("state", new)) if c in columns})
    return sorted(((k, v["race"], v["state"]) for k, v in state.items()), key=str)


@pytest.mark.parametrize("listed", [0, snapshots.LISTED])
def test_a_local_batch_rewrites_few_files(spark, table, monkeypatch, listed):
    monkeypatch.setattr(snapshots, "LISTED", listed)  # 0: found by the batch's bounds
    before, files = rows_of(table.read("T")), set(table.files("T"))
    batch = [(i, 99, f"new {i}") for i in range(1200, 1210)]
    done = table.update("T", spark.createDataFrame(batch, "id long, race long, state string"), "id", cluster=["id"])
    assert done.files == FILES and len(done.rewritten) < FILES * 0.05 + 1 and done.version == 2
    assert rows_of(table.read("T")) == applied(before, batch)
    assert rows_of(table.read("T", version=1)) == before  # the older version stays
    assert len(files & set(table.files("T"))) == FILES - len(done.rewritten)
    again = table.update("T", spark.createDataFrame(batch, "id long, race long, state string"), "id", cluster=["id"])
    assert len(again.rewritten) <= 2 and rows_of(table.read("T")) == applied(before, batch)


def test_scattered_repeated_unknown_and_null_keys(spark, table):
    before = rows_of(table.read("T"))
    batch = [(i, 50, "a") for i in range(0, 4000, 97)] + [(97, 51, "b"), (10_000, 1, "none"), (None, 1, "none")]
    changes = spark.createDataFrame([(*b, n) for n, b in enumerate(batch)], "id long, race long, state string, seq long")
    done = table.update("T", changes, "id", seq="seq", cluster=["id"])
    assert rows_of(table.read("T")) == applied(before, batch) and len(done.rewritten) > FILES / 2
    # some columns only (S9), without a seq
    before = rows_of(table.read("T"))
    table.update("T", spark.createDataFrame([(5, "only")], "id long, state string"), "id", columns=["state"])
    assert rows_of(table.read("T")) == applied(before, [(5, None, "only")], columns=("state",))


def test_a_batch_without_known_keys_makes_no_version(spark, table):
    empty = spark.createDataFrame([], "id long, race long, state string")
    unknown = spark.createDataFrame([(-1, 1, "x"), (None, 1, "x")], "id long, race long, state string")
    for batch in (empty, unknown):
        assert table.update("T", batch, "id") == snapshots.Update(1, [], FILES)
    assert table.version() == 1


def test_only_key_columns_of_near_row_groups_are_read(spark, table):
    """The search for the files reads the key column and pushes the batch's keys down."""
    seen = []
    real = snapshots.join_on_hot_key

    def spy(left, right, keys, how):
        seen.append(left._jdf.queryExecution().executedPlan().toString())
        return real(left, right, keys, how)
    snapshots.join_on_hot_key = spy
    try:
        table.update("T", spark.createDataFrame([(7, 1, "x")], "id long, race long, state string"), "id")
    finally:
        snapshots.join_on_hot_key = real
    assert "ReadSchema: struct<id:bigint>" in seen[0] and "PushedFilters: [" in seen[0] and "EqualTo(id,7)" in seen[0].replace("In(id, [7])", "EqualTo(id,7)")


def test_tables_appear_together_or_not_at_all(spark, store):
    store.create({"Race": spark.createDataFrame([(1,)], "RaceId long"), "Result": spark.createDataFrame([(1, 1)], "ResultId long, RaceId long")})
    lost = spark.range(3).select(F.raise_error(F.lit("executor lost")).cast("long").alias("ResultId"), F.col("id").alias("RaceId"))
    with pytest.raises(Exception, match="executor lost"):
        store.append({"Race": spark.createDataFrame([(2,)], "RaceId long"), "Result": lost})
    assert store.version() == 1 and rows_of(store.read("Race")) == [(1,)]
    new = {"Race": spark.createDataFrame([(2,)], "RaceId long"), "Result": spark.createDataFrame([(2, 2)], "ResultId long, RaceId long")}
    store.append(new)
    assert rows_of(store.read("Race")) == [(1,), (2,)] and rows_of(store.read("Result")) == [(1, 1), (2, 2)]


def test_checks_decide_before_anything_is_visible(spark, store):
    store.create({"T": spark.createDataFrame([(1, "a"), (2, "b")], "id long, place string")})

    def unique(tables):
        return {"unique place": tables["T"].groupBy("place").count().filter("count > 1")}
    with pytest.raises(ConstraintViolation, match="unique place"):
        store.update("T", spark.createDataFrame([(2, "a")], "id long, place string"), "id", checks=unique)
    assert store.version() == 1 and rows_of(store.read("T")) == [(1, "a"), (2, "b")]
    store.update("T", spark.createDataFrame([(2, "a"), (1, "b")], "id long, place string"), "id", checks=unique)  # a swap
    assert rows_of(store.read("T")) == [(1, "b"), (2, "a")]


def test_the_second_of_two_writers_starts_again(spark, store):
    one = spark.createDataFrame([(1,)], "id long")
    store.create({"T": one})
    parts = {"T": store.put_aside("T", one)}
    store.append({"T": one})
    with pytest.raises(VersionConflict):
        store.commit_parts(1, parts)
    assert store.read("T").count() == 2
    assert store.commit_parts(store.version(), parts) == 3 and store.read("T").count() == 3


def test_empty_table_and_struct_keys(spark, store):
    store.create({"T": spark.createDataFrame([], "k struct<a:long,b:long>, v string")})
    assert store.read("T").count() == 0
    store.append({"T": spark.createDataFrame([((1, 1), "x"), ((1, 2), "y")], "k struct<a:long,b:long>, v string")})
    store.update("T", spark.createDataFrame([((1, 2), "z")], "k struct<a:long,b:long>, v string"), "k")
    assert [(tuple(r.k), r.v) for r in store.read("T").orderBy("v").collect()] == [((1, 1), "x"), ((1, 2), "z")]


def test_one_layout_for_two_filters(spark, store):
    """Files along a curve over both columns: a range of the first and a value of the second each open under a fifth."""
    df = spark.range(60_000).select((F.col("id") % 9973).alias("RaceId"), ((F.col("id") * 7919) % 997).alias("DriverId"), F.col("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 5, -1), (5, None, -2)], "RaceId long, DriverId long, v long"))
    rows = along_curve(df, "RaceId", "DriverId")
    part = store.put_aside("T", rows, cluster=[CURVE], files=256, ranges=["RaceId", "DriverId"])
    store.commit(0, {"T": {"schema": df.schema.jsonValue(), "parts": [part]}})
    files = len(store.files("T"))
    by_race, by_driver = store.read_near("T", 1, {"RaceId": [(4000, 4200)]}), store.read_near("T", 1, {"DriverId": [(500, 500)]})
    assert files > 200 and len(by_race.inputFiles()) <= 0.2 * files and len(by_driver.inputFiles()) <= 0.2 * files
    assert rows_of(by_race.filter("RaceId BETWEEN 4000 AND 4200")) == rows_of(df.filter("RaceId BETWEEN 4000 AND 4200"))
    assert rows_of(by_driver.filter("DriverId = 500")) == rows_of(df.filter("DriverId = 500"))
    assert store.read("T").count() == df.count()
    assert store.read_near("T", 1, {"RaceId": [(-9, -1)]}).count() == 0
