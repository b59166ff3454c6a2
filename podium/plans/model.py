"""Binding of the racing roles onto the driver's TPC-H-like tables.

The racing base data is not available, so each role is a projection of a test
table (SURVEY section 7.2). Renames are free: Catalyst prunes columns and pushes
filters through them into the parquet scan. Every binding here has a twin in
``podium.plans.oracle`` so the DuckDB check reads the same model.

order model (one order = one race):
  Race    orders    RaceId=o_orderkey, RaceYear=year(o_orderdate), RaceDate, CustomerId=o_custkey
  Result  lineitem  RaceId=l_orderkey, DriverId=l_suppkey, PartId=l_partkey,
                    Position=l_linenumber, Laps=l_quantity, FastestLapTime=l_extendedprice,
                    ResultNumber=l_partkey, ResultStatus=l_returnflag, Points=l_discount
  Driver  supplier (career questions), part (Q1, names split F12), customer (Q4)
  Circuit nation, reached through the ordering customer (plans.analytics._q2_races)

championship model (Q3, Q7; one calendar month = one round):
  RoundResult  per (year, month, nation): Points = order value, Position = rank in the round,
               Constructor = the market segment with the most value that round
  Standing     cumulative points per (season, nation) after every round of the season
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions import after_first_word, first_word, nth_part
from podium.operators.standings import rank_in_round
from podium.sources.tables import Tables


def race(t: Tables, years: tuple[int, int] | None = None) -> DataFrame:
    """Orders as races. ``years=(lo, hi)`` keeps seasons lo..hi with a range
    predicate on the raw order date, which parquet can push down and prune row
    groups with; a ``year(date)`` predicate cannot be pushed."""
    orders = t.orders
    if years is not None:
        lo, hi = years
        orders = orders.filter((F.col("o_orderdate") >= F.lit(f"{lo}-01-01").cast("timestamp_ntz"))
                               & (F.col("o_orderdate") < F.lit(f"{hi + 1}-01-01").cast("timestamp_ntz")))
    return orders.select(
        F.col("o_orderkey").alias("RaceId"),
        F.year("o_orderdate").alias("RaceYear"),
        F.to_date("o_orderdate").alias("RaceDate"),
        F.col("o_custkey").alias("CustomerId"),
    )


def result(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("RaceId"),
        F.col("l_suppkey").alias("DriverId"),
        F.col("l_partkey").alias("PartId"),
        F.col("l_linenumber").alias("Position"),
        F.col("l_linenumber").cast("string").alias("PositionText"),
        F.col("l_linenumber").alias("FastestLap"),
        F.col("l_quantity").alias("Laps"),
        F.col("l_extendedprice").alias("FastestLapTime"),
        F.col("l_partkey").alias("ResultNumber"),
        F.col("l_discount").alias("Points"),
        F.col("l_returnflag").alias("ResultStatus"),
    )


def supplier_driver(t: Tables) -> DataFrame:
    """Drivers without a last name: F1 skips the NULL, F3 would give NULL."""
    return t.supplier.select(
        F.col("s_suppkey").alias("DriverId"),
        F.col("s_name").alias("Firstname"),
        F.lit(None).cast("string").alias("Lastname"),
        F.col("s_nationkey").alias("NationId"),
    )


def part_driver(t: Tables) -> DataFrame:
    """Part names split at the first space into first and last name."""
    return t.part.select(
        F.col("p_partkey").alias("DriverId"),
        first_word("p_name").alias("Firstname"),
        after_first_word("p_name").alias("Lastname"),
    )


def customer_driver(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("DriverId"),
        F.col("c_name").alias("Firstname"),
        F.lit(None).cast("string").alias("Lastname"),
    )


# -- championship model (Q3, Q7) --------------------------------------------------------------

def round_results(t: Tables) -> DataFrame:
    """One result per (round, nation): Points, Position in the round, constructor.

    Order values are pre-aggregated per (round, nation, segment) before the
    per-round ranking, so the ranking window sees one row per competitor.
    """
    sale = (t.orders.select(F.year("o_orderdate").alias("RaceYear"),
                            F.month("o_orderdate").alias("NrOfRound"),
                            F.col("o_custkey").alias("c_custkey"),
                            F.col("o_totalprice").cast("decimal(18,2)").alias("Value"))
            .join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey"))
    seg = (sale.groupBy("RaceYear", "NrOfRound", "c_nationkey", "c_mktsegment")
           .agg(F.sum("Value").alias("SegPoints")))
    per = (seg.groupBy("RaceYear", "NrOfRound", F.col("c_nationkey").alias("DriverId"))
           .agg(F.sum("SegPoints").alias("Points"),
                F.min_by("c_mktsegment", F.struct(-F.col("SegPoints"), F.col("c_mktsegment")))
                .alias("ConstructorName"))
           .withColumn("RaceId", F.col("RaceYear") * 100 + F.col("NrOfRound"))
           .withColumn("ResultId", F.col("RaceId").cast("long") * 1000 + F.col("DriverId")))
    return rank_in_round(per, race="RaceId", points="Points", entity="DriverId")


def rounds(results_by_round: DataFrame) -> DataFrame:
    """The championship's races: one per (season, month) that has results."""
    return (results_by_round.select("RaceId", "RaceYear", "NrOfRound").distinct()
            .withColumn("RaceDate", F.make_date("RaceYear", "NrOfRound", F.lit(1)).cast("string"))
            .withColumn("RaceName", F.concat(F.lit("Round "), F.col("NrOfRound").cast("string"))))


def nation_driver(t: Tables) -> DataFrame:
    """Nations as competitors; 'NATION_7' splits into 'NATION' and '7' (F15)."""
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("DriverId"),
                    nth_part("n_name", "_", 1).alias("Firstname"),
                    nth_part("n_name", "_", 2).alias("Lastname"),
                    F.col("r_name").alias("Nationality")))
