"""Registered layout queries (S11-S13): the same questions answered from clustered copies.

Each layout is written once per version of its inputs (and of the code that derives it) into the shared
folder, then read by the question: the answer must equal the question on the plain tables, while the plan loses the shuffle
(S11, S12) or prunes by range (S13). Bucket and file counts follow from the inputs' bytes.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.fastest import fastest_per_group
from podium.operators.shares import season_win_share
from podium.plans import analytics, championship, model
from podium.sources.clustering import CURVE, along_curve
from podium.sources.snapshots import Snapshots
from podium.sources.sinks import (
    files_for, input_fingerprint, path_exists, save_bucketed, shared_folder, write_range_clustered,
)
from podium.sources.tables import read_tables



def _inputs(root: str, *names: str) -> list[str]:
    return [f"{root.rstrip('/')}/{n}.parquet" for n in names]


def _bucketed(spark: SparkSession, name: str, fingerprint: str, rows, bucket_by: list[str], sort_by: list[str], buckets: int) -> DataFrame:
    """The bucketed table of that name and version, made if it is not in the catalog yet."""
    table = f"podium_{name}_{fingerprint}"
    if not spark.catalog.tableExists(table):
        save_bucketed(rows(), table, bucket_by=bucket_by, sort_by=sort_by, buckets=buckets)
    return spark.table(table)


def s11_bucketed_win_share(spark: SparkSession, root: str) -> DataFrame:
    """Results and races bucketed on RaceId; Q6's race join needs no exchange."""
    t = read_tables(spark, root)
    inputs = _inputs(root, "lineitem", "orders")
    fp = input_fingerprint(spark, inputs, inspect.getsource(model))
    n = files_for(spark, inputs)
    results = _bucketed(spark, "results", fp, lambda: model.result(t).select("RaceId", "DriverId", "Position"),
                        ["RaceId"], ["RaceId", "DriverId"], n)
    races = _bucketed(spark, "races", fp, lambda: model.race(t).select("RaceId", "RaceYear"), ["RaceId"], ["RaceId"], n)
    return analytics._q6_report(t, season_win_share(results, races))


def s12_standings_results(spark: SparkSession, root: str) -> DataFrame:
    """Standings bucketed on RaceId next to round results bucketed alike: every competitor's result in the
    round beside his standing after it, joined per race without an exchange on either side."""
    _, rr, _, standings = championship._championship(spark, root)
    inputs = _inputs(root, "orders", "customer")
    fp = input_fingerprint(spark, inputs, inspect.getsource(championship) + inspect.getsource(model))
    n = files_for(spark, inputs)
    results = _bucketed(spark, "round_results", fp, lambda: rr.select(
        "RaceId", "DriverId", F.col("Position").alias("Place"), F.col("Points").alias("Scored")), ["RaceId"], ["RaceId", "DriverId"], n)
    table = _bucketed(spark, "standings", fp, lambda: standings.select("RaceId", "DriverId", "Position", "Points"),
                      ["RaceId"], ["RaceId", "DriverId"], n)
    # the race alone places both sides: its buckets hold all competitors of a race
    joined = table.hint("merge").join(results, ["RaceId", "DriverId"], "left")
    return joined.select(F.col("RaceId").cast("long").alias("RaceId"), F.col("DriverId").cast("long").alias("DriverId"),
                         F.col("Position").cast("long").alias("Position"), F.col("Points").cast("double").alias("Points"),
                         F.col("Place").cast("long").alias("Place"), F.col("Scored").cast("double").alias("Scored"))


def _clustered(spark: SparkSession, root: str) -> DataFrame:
    """Results range-clustered on RaceId, sorted by lap time, written once per version."""
    inputs = _inputs(root, "lineitem")
    fp = input_fingerprint(spark, inputs, inspect.getsource(model.result))
    path = shared_folder(spark, f"s13_results/{fp}")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_range_clustered(model.result(read_tables(spark, root)), path, cluster_by=["RaceId"],
                              sort_by=["RaceId", "FastestLapTime"], partitions=files_for(spark, inputs))
    return spark.read.parquet(path)


def s13_clustered_fastest(spark: SparkSession, root: str) -> DataFrame:
    """The fastest results of the middle fifth of the races (Q2 without its context). The range is pushed to the
    scan, where the files' and row groups' bounds on RaceId skip all others."""
    low, high = _middle_races(spark, root)
    return _fastest(_clustered(spark, root).filter(F.col("RaceId").between(low, high)))


def _fastest(rows: DataFrame) -> DataFrame:
    best = fastest_per_group(rows, group="RaceId", value="FastestLapTime", tiebreak=("Position", "PartId", "DriverId"))
    return best.select("RaceId", "DriverId", "PartId", F.col("Position").cast("long").alias("Position"), "FastestLapTime", "Laps")


def _middle_races(spark: SparkSession, root: str) -> tuple[int, int]:
    """The ends of the middle fifth of the range of race ids."""
    ends = read_tables(spark, root).orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).first()
    span = ends.high - ends.low
    return ends.low + span * 2 // 5, ends.low + span * 3 // 5


def _on_curve(spark: SparkSession, root: str) -> Snapshots:
    """Results along a curve over (RaceId, DriverId), written once per version; the pointer keeps each file's ranges. Four
    times as many files as bytes ask for, and 64 at least, since a filter meets about their square root."""
    inputs = _inputs(root, "lineitem")
    fp = input_fingerprint(spark, inputs, inspect.getsource(model.result) + inspect.getsource(along_curve))
    store = Snapshots(spark, shared_folder(spark, f"s13_curve/{fp}"))
    if store.version() == 0:
        rows = along_curve(model.result(read_tables(spark, root)), "RaceId", "DriverId")
        part = store.put_aside("Result", rows, cluster=[CURVE], files=max(64, 4 * files_for(spark, inputs)), ranges=["RaceId", "DriverId"])
        store.commit(0, {"Result": {"schema": rows.drop(CURVE).schema.jsonValue(), "parts": [part]}})
    return store


def s13_curve_races(spark: SparkSession, root: str) -> DataFrame:
    """S13 on the layout for both filters: the same question by race; files outside the range are not opened."""
    store, ends = _on_curve(spark, root), _middle_races(spark, root)
    return _fastest(store.read_near("Result", 1, {"RaceId": [ends]}).filter(F.col("RaceId").between(*ends)))


def s13_curve_driver(spark: SparkSession, root: str) -> DataFrame:
    """The other index's question on the same files: all results of the driver in the middle of the ids."""
    ends = read_tables(spark, root).supplier.agg(F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("high")).first()
    driver = (ends.low + ends.high) // 2
    rows = _on_curve(spark, root).read_near("Result", 1, {"DriverId": [(driver, driver)]}).filter(F.col("DriverId") == driver)
    return rows.select("RaceId", "DriverId", "PartId", F.col("Position").cast("long").alias("Position"), "FastestLapTime", "Laps")


QUERIES = {
    "s11_bucketed_win_share": s11_bucketed_win_share,
    "s12_standings_results": s12_standings_results,
    "s13_clustered_fastest": s13_clustered_fastest,
    "s13_curve_races": s13_curve_races,
    "s13_curve_driver": s13_curve_driver,
}
