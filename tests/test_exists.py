"""Existence with a comparison, against all pairs in Python."""

import random

import pytest
from pyspark.sql import functions as F

from podium.operators.exists import exists_between, exists_where

COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b}


def tables(spark, seed):
    """Ties, NULL keys and values, a key with most rows, keys on one side only, repeated rows."""
    r = random.Random(seed)

    def rows(n, extra):
        return [(i, r.choice(["hot"] * 5 + ["a", "b", None, extra]), r.choice([None, *range(12)]), r.randrange(6)) for i in range(n)]
    left, right = rows(300, "left"), rows(200, "right")
    schema = "id long, k string, x int, span int"
    return left, right, spark.createDataFrame(left, schema).repartition(6), spark.createDataFrame(right, schema).select("k", F.col("x").alias("y")).repartition(5)


@pytest.mark.parametrize("comparison", sorted(COMPARE))
def test_exists_equals_all_pairs(spark, comparison):
    left, right, a, b = tables(spark, 1)
    found = {i for i, k, x, _ in left if any(k is not None and k == q and x is not None and y is not None and COMPARE[comparison](x, y) for _, q, y, _ in right)}
    for anti in (False, True):
        got = exists_where(a, b, "k", "x", comparison, "y", anti=anti)
        assert got.columns == a.columns
        assert sorted(r.id for r in got.collect()) == sorted(i for i, *_ in left if (i in found) != anti)


def test_between_equals_all_pairs(spark):
    left, right, a, b = tables(spark, 2)
    found = {i for i, k, x, s in left if any(k is not None and k == q and None not in (x, y) and x <= y <= x + s - 2 for _, q, y, _ in right)}
    for anti in (False, True):
        got = exists_between(a, b, ["k"], F.col("x"), F.col("x") + F.col("span") - 2, "y", anti=anti)
        assert got.columns == a.columns
        assert sorted(r.id for r in got.collect()) == sorted(i for i, *_ in left if (i in found) != anti)
    assert 0 < len(found) < 300


def test_empty_right_side(spark):
    _, _, a, b = tables(spark, 3)
    none = b.limit(0)
    assert exists_where(a, none, "k", "x", "<", "y").count() == 0 and exists_where(a, none, "k", "x", "<", "y", anti=True).count() == 300
    assert exists_between(a, none, "k", F.col("x"), F.col("x"), "y").count() == 0


def test_no_pairs_of_a_hot_key(spark):
    """20,000 rows of one key on both sides: 400 million pairs for a join on the key, none here."""
    a = spark.range(20_000).select("id", F.lit("hot").alias("k"), F.col("id").alias("x"))
    b = a.select("k", F.col("x").alias("y"))
    assert exists_where(a, b, "k", "x", "<", "y", anti=True).select("id").collect()[0].id == 19_999
    assert exists_between(a, b, "k", F.col("x") + 1, F.col("x") + 5, "y").count() == 19_999
