"""Registered ingest queries (I2, I6, I7) on the test tables.

Binding: customers are the driver dimension (id ``c_custkey``, natural key the
name); customers seen on orders before ``DIM_CUT`` form the loaded dimension and
later orders are the staged feed. For facts, lineitems shipped before
``integrity.CUT`` are loaded (numbered densely by key) and later ones are staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.ingest import load_dimension, load_fact
from podium.operators.keys import dense_index
from podium.plans.integrity import CUT
from podium.sources.tables import read_tables

DIM_CUT = "1996-01-01"
KEY_ORDER = ["RaceId", "Position", "PartId", "DriverId", "ShipDate"]


def _customers_by_period(t):
    named = (t.orders.select("o_custkey", "o_orderdate")
             .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"))
    cut = F.lit(DIM_CUT).cast("timestamp_ntz")
    existing = (named.filter(F.col("o_orderdate") < cut)
                .select(F.col("o_custkey").alias("DriverId"), F.col("c_name").alias("DriverRef")).distinct())
    staged = named.filter(F.col("o_orderdate") >= cut).select(F.col("c_name").alias("DriverRef"))
    return existing, staged


def i2_new_dimension(spark: SparkSession, root: str) -> DataFrame:
    """New dimension members from a staged feed, ids continuing from MAX(id)
    (G9 distinct, J9 anti-join, G7 + W7 via the distributed dense index)."""
    t = read_tables(spark, root)
    existing, staged = _customers_by_period(t)
    new = load_dimension(staged, existing, natural_key={"DriverRef": F.col("DriverRef")},
                         surrogate="DriverId", order=["DriverRef"], attributes={})
    return new.select(F.col("DriverId").cast("long").alias("DriverId"), "DriverRef")


def _lines(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("RaceId"), F.col("l_linenumber").alias("Position"),
        F.col("l_partkey").alias("PartId"), F.col("l_suppkey").alias("DriverId"),
        F.col("l_shipdate").alias("ShipDate"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("ResultKey"))


def i6_surrogate_keys(spark: SparkSession, root: str) -> DataFrame:
    """Dense ids 1..n over the whole fact table in key order, no single-task window."""
    t = read_tables(spark, root)
    return dense_index(_lines(t), KEY_ORDER, out="ResultId").select("ResultKey", "ResultId")


def i7_new_facts(spark: SparkSession, root: str) -> DataFrame:
    """Staged facts whose (race, driver) is not loaded yet, numbered on from MAX(ResultId)."""
    t = read_tables(spark, root)
    lines = _lines(t)
    cut = F.lit(CUT).cast("timestamp_ntz")
    loaded = dense_index(lines.filter(F.col("ShipDate") < cut), KEY_ORDER, out="ResultId")
    staged = lines.filter(F.col("ShipDate") >= cut)
    new = load_fact(staged, loaded, natural_key=["RaceId", "DriverId"], surrogate="ResultId", order=KEY_ORDER)
    return new.select("ResultKey", "ResultId")


QUERIES = {
    "i2_new_dimension": i2_new_dimension,
    "i6_surrogate_keys": i6_surrogate_keys,
    "i7_new_facts": i7_new_facts,
}
