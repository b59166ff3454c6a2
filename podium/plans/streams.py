"""Registered streaming queries (T-S1): the later results arrive as a change feed, a delivery a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import rules as R
from podium.plans import integrity
from podium.sources.sinks import fresh_folder
from podium.sources.tables import read_tables
from podium.streaming.validate import read_reports, validate_feed


def _replay(spark: SparkSession, rows: DataFrame, date: str, base: DataFrame, races: DataFrame, rule) -> DataFrame:
    """Deliver ``rows`` year by year to a watched folder and let the stream check each delivery as one
    micro-batch against the base and what earlier deliveries were granted. The number of deliveries is
    that of the years in the feed."""
    folder, out = fresh_folder(spark, "feed"), fresh_folder(spark, "ts1")
    years = sorted(r[0] for r in rows.select(F.year(date)).distinct().collect())
    for year in years:
        rows.filter(F.year(date) == year).drop(date).write.mode("append").parquet(folder)
        feed = spark.readStream.schema(rows.drop(date).schema).parquet(folder)
        validate_feed(spark, feed, base=base, races=races, rule=rule, out_dir=out, checkpoint=f"{out}/_checkpoint").awaitTermination()
    return read_reports(spark, out)


def _results_feed(spark: SparkSession, root: str, rule) -> DataFrame:
    t = read_tables(spark, root)
    base, later = integrity._split(t)
    report = _replay(spark, later.select(*integrity.RESULT_COLS, "seq", "ShipDate"), "ShipDate",
                     base.select(*integrity.RESULT_COLS), integrity.races(t), rule)
    return report.select(integrity.result_id_text("ResultId").alias("ResultId"), "Status", "Error")


def ts1_stream(spark: SparkSession, root: str) -> DataFrame:
    """T-S1 under the position rule: several micro-batches on a base that holds earlier results."""
    return _results_feed(spark, root, R.position_rule(integrity.POSITION_GATE))


def ts1_stream_driver(spark: SparkSession, root: str) -> DataFrame:
    """T-S1 under the driver rule."""
    return _results_feed(spark, root, R.driver_rule(integrity.DRIVER_GATE))


def ts1_stream_number(spark: SparkSession, root: str) -> DataFrame:
    """T-S1 under the number rule."""
    return _results_feed(spark, root, R.number_owner_rule(integrity.NUMBER_GATE))


def ts1_stream_cap(spark: SparkSession, root: str) -> DataFrame:
    """T-S1 under the season cap: races arrive."""
    t = read_tables(spark, root)
    r, cut = integrity.races(t), F.lit(integrity.CUT).cast("timestamp_ntz")
    rule = R.season_cap_rule(integrity.SEASON_CAP, group=("CustomerId", "RaceYear"))
    cols = ["RaceId", "RaceYear", "CustomerId"]
    report = _replay(spark, r.filter(F.col("RaceDate") >= cut).select(*cols, "seq", "RaceDate"), "RaceDate",
                     r.filter(F.col("RaceDate") < cut).select(*cols), r, rule)
    return report.select("RaceId", "Status", "Error")


QUERIES = {
    "ts1_stream": ts1_stream,
    "ts1_stream_driver": ts1_stream_driver,
    "ts1_stream_number": ts1_stream_number,
    "ts1_stream_cap": ts1_stream_cap,
}
