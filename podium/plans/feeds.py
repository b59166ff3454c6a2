"""Registered ingest queries (S2, S3, I3-I5, I7, S7) on delimited text.

Binding: every lineitem is a line of a result file, written as text to the shared folder and read
from there. The race number is year and month of the order, the circuit the month, the driver the
supplier, the car the order priority. Lines with tax 8% lack their last fields, lines with
discount 10% are blank, a quantity of 50 reads ``DNF`` as position, some drivers have one-word names, some lines no driver,
and a low priority no car - so every outcome of the tolerant load and of the job occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import ingest
from podium.plans.ingest_job import run_ingest_as_one
from podium.sources.delimited import read_delimited, tolerant_load
from podium.sources.sinks import fresh_folder
from podium.sources.snapshots import Snapshots
from podium.sources.tables import read_tables

# Columns of the racing tables as the job fills them.
TABLE_DDL = {
    "Circuit": "CircuitId int, CircuitRef string, CircuitName string, CircuitLocation string, Country string",
    "Constructor": "ConstructorId int, ConstructorRef string, ContstructorName string, Nationality string, ConstructorUrl string",
    "Driver": "DriverId int, DriverRef string, DriverNumber int, Firstname string, Lastname string, Nationality string",
    "Season": "RaceYear int, SeasonUrl string",
    "Race": "RaceId int, RaceYear int, NrOfRound int, CircuitId int, RaceName string, RaceDate date",
    "Result": ("ResultId int, RaceId int, DriverId int, ConstructorId int, ResultNumber int, Grid int, Position int, PositionText string, "
               "PositionOrder int, Points decimal(18,4), Laps int, Time string, ResultStatusId int"),
}


def _lines(t) -> DataFrame:
    """line, and whether it is sound (complete, not blank, all numbers numeric)."""
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"), "l_orderkey")
    short = F.round(F.col("l_tax") * 100) == 8
    blank = F.round(F.col("l_discount") * 100) == 10
    stopped = F.col("l_quantity") == 50
    driver = (F.when((F.col("l_suppkey") % 13 == 0) & (F.col("l_linenumber") == 1), F.lit(""))
              .when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("Solo"), "l_suppkey"))
              .otherwise(F.concat(F.lit("Rider "), "l_suppkey")))
    month = F.month("o_orderdate")
    fields = [(F.year("o_orderdate") * 100 + month).cast("string"), F.concat(F.lit("Circuit "), month.cast("string")),
              F.when(stopped, F.lit("DNF")).otherwise(F.col("l_linenumber").cast("string")), F.col("l_suppkey").cast("string"),
              driver, F.when(F.col("o_orderpriority").startswith("5"), F.lit("")).otherwise(F.col("o_orderpriority")),
              F.col("l_quantity").cast("int").cast("string")]
    last = [F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linenumber").cast("string")]
    line = (F.when(blank, F.lit("  ")).when(short, F.concat_ws(";", *fields)).otherwise(F.concat_ws(";", *fields, *last)))
    return rows.select(line.alias("line"), (~short & ~blank & ~stopped).alias("sound"))


def _file(spark: SparkSession, root: str, sound_only: bool = False) -> str:
    """The text file of all lines, or of the sound ones."""
    lines = _lines(read_tables(spark, root))
    path = fresh_folder(spark, "result_file")
    (lines.filter("sound") if sound_only else lines).select("line").write.text(path)
    return path


def s2_strict_csv(spark: SparkSession, root: str) -> DataFrame:
    """The sound lines through the strict reader."""
    return read_delimited(spark, _file(spark, root, sound_only=True), header=False)


def s3_tolerant_load(spark: SparkSession, root: str) -> DataFrame:
    """S3 (F7, F13, F14): all lines, numbers that do not convert as NULL, blank lines gone."""
    return tolerant_load(spark, _file(spark, root))[0]


def s3_rejects(spark: SparkSession, root: str) -> DataFrame:
    """S3: the lines that lost something, with the reason."""
    return tolerant_load(spark, _file(spark, root))[1]


def _stage(spark: SparkSession, root: str) -> DataFrame:
    stage, _ = tolerant_load(spark, _file(spark, root))
    return stage.withColumn("Car", F.coalesce(F.nullif(F.trim("Car"), F.lit("")), F.lit("UNKNOWN")))


def i3_new_constructors(spark: SparkSession, root: str) -> DataFrame:
    """Cars not known yet, whatever their case, the default for lines without one; two are known."""
    known = (read_tables(spark, root).orders.select(F.lower("o_orderpriority").alias("ContstructorName")).distinct()
             .filter(F.substring("ContstructorName", 1, 1).isin("1", "2"))
             .withColumn("ConstructorId", F.substring("ContstructorName", 1, 1).cast("int")))
    new = ingest._new_constructors(_stage(spark, root), known)
    return new.select(F.col("ConstructorId").cast("long").alias("ConstructorId"), "ContstructorName", "Nationality")


def i4_new_drivers(spark: SparkSession, root: str) -> DataFrame:
    """I4: drivers not known by name yet, names split at the first space; those with an even number are known."""
    known = read_tables(spark, root).supplier.filter(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("DriverId"), F.lit("RIDER").alias("Firstname"), F.col("s_suppkey").cast("string").alias("Lastname"))
    new = ingest._new_drivers(_stage(spark, root), known)
    return new.select(F.col("DriverId").cast("long").alias("DriverId"), "DriverRef", F.col("DriverNumber").cast("long").alias("DriverNumber"),
                      "Firstname", "Lastname")


def i5_seasons_races(spark: SparkSession, root: str) -> DataFrame:
    """I5 (F16): races from the race numbers, with their circuits' new ids."""
    stage = _stage(spark, root)
    circuits = ingest._new_circuits(stage, spark.createDataFrame([], TABLE_DDL["Circuit"]))
    races = ingest._new_races(stage, spark.createDataFrame([], TABLE_DDL["Race"]), circuits, "2020-02-02")
    return races.select(*[F.col(c).cast("long").alias(c) for c in ("RaceId", "RaceYear", "NrOfRound", "CircuitId")],
                              "RaceName", F.col("RaceDate").cast("string").alias("RaceDate"))


def _ingested(spark: SparkSession, root: str, runs: int) -> tuple[Snapshots, DataFrame]:
    store = Snapshots(spark, fresh_folder(spark, "racing_tables"))
    store.create({name: spark.createDataFrame([], ddl) for name, ddl in TABLE_DDL.items()})
    path, rejects = _file(spark, root), None
    for _ in range(runs):
        _, rejects = run_ingest_as_one(spark, path, store)
    return store, rejects


def i7_ingest_job(spark: SparkSession, root: str) -> DataFrame:
    """The whole job run twice on one file, all tables in one commit. The rows of the stored
    results, whose ids are resolved to names again; the second run must not have added any."""
    store, _ = _ingested(spark, root, runs=2)
    table = store.read
    return (table("Result").join(table("Race").select("RaceId", "RaceYear", "NrOfRound"), "RaceId")
            .join(table("Driver").select("DriverId", "DriverRef"), "DriverId")
            .join(table("Constructor").select("ConstructorId", "ContstructorName"), "ConstructorId")
            .select(F.col("RaceYear").cast("long").alias("RaceYear"), F.col("NrOfRound").cast("long").alias("NrOfRound"), "DriverRef",
                    "ContstructorName", F.col("Position").cast("long").alias("Position"), F.col("Laps").cast("long").alias("Laps"), "Time",
                    F.col("Points").cast("double").alias("Points")))


def i7_ingest_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The job's report: lines that did not parse, and lines that found no driver."""
    return _ingested(spark, root, runs=1)[1]


QUERIES = {
    "s2_strict_csv": s2_strict_csv,
    "s3_tolerant_load": s3_tolerant_load,
    "s3_rejects": s3_rejects,
    "i3_new_constructors": i3_new_constructors,
    "i4_new_drivers": i4_new_drivers,
    "i5_seasons_races": i5_seasons_races,
    "i7_ingest_job": i7_ingest_job,
    "i7_ingest_rejects": i7_ingest_rejects,
}
