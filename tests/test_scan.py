"""The distributed scan against Spark's windows, also where one group holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.operators.scan import last_seen, previous, running_count, running_max, running_min, running_sum, scan


def _rows(seed, n=3000):
    r = random.Random(seed)
    return [(i, r.choice(["hot"] * 4 + ["a", "b", None]), r.choice([None, r.randrange(100)]), r.randrange(10**6)) for i in range(n)]


@pytest.fixture()
def table(spark):
    def make(rows):
        return spark.createDataFrame(rows, "id long, g string, x long, o long").repartition(7)
    return make


@pytest.mark.parametrize("group", [["g"], []])
def test_scan_equals_window(table, group):
    df = table(_rows(1))
    got = scan(df, group, ["o", "id"], s=running_sum("x"), c=running_count("x"), n=running_count(), lo=running_min("x"),
               hi=running_max("x"), p=previous("x"), l=last_seen("x"))
    w = Window.partitionBy(*group).orderBy("o", "id")
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("*", F.sum("x").over(rows).alias("s"), F.count("x").over(rows).alias("c"), F.row_number().over(w).cast("long").alias("n"),
                     F.min("x").over(rows).alias("lo"), F.max("x").over(rows).alias("hi"), F.lag("x").over(w).alias("p"),
                     F.last("x", ignorenulls=True).over(rows).alias("l"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_descending_order_and_replaced_column(table):
    df = table(_rows(2, 500))
    got = {r.id: r.x for r in scan(df, ["g"], [F.col("o").desc(), "id"], x=running_sum("x")).collect()}
    w = Window.partitionBy("g").orderBy(F.col("o").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert got == {r.id: r.y for r in df.select("id", F.sum("x").over(w).alias("y")).collect()}


def test_empty_table(table):
    assert scan(table([]), ["g"], ["o"], s=running_sum("x")).collect() == []


def test_a_hot_group_is_spread(spark, table):
    """A group with all rows lies in several partitions of the scan; under a window it is one."""
    df = table([(i, "hot", 1, i) for i in range(5000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 5000 rows would fit one partition
    try:
        def sizes(rows):
            return sorted(r["count"] for r in rows.filter("s > 0").groupBy(F.spark_partition_id()).count().collect())
        spread = sizes(scan(df, ["g"], ["o"], s=running_sum("x")))
        window = sizes(df.select(F.sum("x").over(Window.partitionBy("g").orderBy("o")).alias("s")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert window == [5000]
    assert sum(spread) == 5000 and max(spread) < 2500
