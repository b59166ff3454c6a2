"""I1-I7 ingest job on the reference's sprint-result file (retyped in tests/data)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from podium.operators.ingest import ingest_race_results
from podium.operators.keys import dense_index
from podium.sources.delimited import read_delimited, tolerant_load

DATA = os.path.join(os.path.dirname(__file__), "data")
CLEAN = os.path.join(DATA, "race_results.csv")
DIRTY = os.path.join(DATA, "race_results_dirty.csv")


def _tables(spark):
    circuit = spark.createDataFrame([(1, "monza", "Monza", "Monza", "Italy")],
                                    "CircuitId int, CircuitRef string, CircuitName string, CircuitLocation string, Country string")
    constructor = spark.createDataFrame([(5, "mercedes", "Mercedes", "German", "")],
                                        "ConstructorId int, ConstructorRef string, ContstructorName string, Nationality string, ConstructorUrl string")
    driver = spark.createDataFrame([(10, "hamilton", 44, "Lewis", "Hamilton", "British")],
                                   "DriverId int, DriverRef string, DriverNumber int, Firstname string, Lastname string, Nationality string")
    season = spark.createDataFrame([(2020, "")], "RaceYear int, SeasonUrl string")
    race = spark.createDataFrame([(100, 2021, 10, 1, "British GP", dt.date(2021, 7, 18))],
                                 "RaceId int, RaceYear int, NrOfRound int, CircuitId int, RaceName string, RaceDate date")
    result = spark.createDataFrame([(500, 100, 10, 5, 44, 2, 2, "2", 2, None, 52, None, 1)],
                                   "ResultId int, RaceId int, DriverId int, ConstructorId int, ResultNumber int, Grid int, "
                                   "Position int, PositionText string, PositionOrder int, Points decimal(18,4), Laps int, "
                                   "Time string, ResultStatusId int")
    return {"Circuit": circuit, "Constructor": constructor, "Driver": driver, "Season": season,
            "Race": race, "Result": result}


def test_strict_reader_reads_nine_rows(spark):
    df = read_delimited(spark, CLEAN)
    assert df.count() == 9
    assert df.filter("RaceNr = 202119").count() == 3


def test_tolerant_load_and_rejects(spark):
    staged, rejects = tolerant_load(spark, DIRTY)
    rows = staged.orderBy("RaceNr", "Driver").collect()
    assert len(rows) == 4                      # blank line dropped, header dropped
    dnf = [r for r in rows if r["Driver"] == "Lando Norris"][0]
    assert dnf["POS"] is None                  # TRY_CAST
    short = [r for r in rows if r["Driver"] == "Lewis Hamilton"][0]
    assert short["TimeRetired"] is None and short["Points"] is None and short["Laps"] == 18
    reasons = {r["line"].split(";")[4]: r["reason"] for r in rejects.collect()}
    assert reasons["Lando Norris"] == "POS is not int"
    assert reasons["Lewis Hamilton"] == "missing fields"


def test_ingest_is_idempotent(spark):
    stage = read_delimited(spark, CLEAN).withColumnRenamed("TIME/RETIRED", "TimeRetired")
    tables = _tables(spark)
    new = ingest_race_results(stage, tables, race_date="2021-12-31")
    circuits = {r["CircuitName"]: r["CircuitId"] for r in new["Circuit"].collect()}
    assert circuits == {"Sao Paulo": 2, "Silverstone": 3}        # Monza known; ids continue from 1
    cars = sorted(r["ContstructorName"] for r in new["Constructor"].collect())
    assert cars == ["FERRARI", "MCLAREN MERCEDES", "RED BULL RACING HONDA"]  # MERCEDES = Mercedes
    drivers = {r["DriverRef"]: (r["DriverId"], r["DriverNumber"], r["Firstname"], r["Lastname"])
               for r in new["Driver"].collect()}
    assert "Lewis Hamilton" not in drivers                        # known by name, not by number
    assert drivers["Max Verstappen"][1:] == (33, "Max", "Verstappen")
    assert sorted(v[0] for v in drivers.values()) == [11, 12, 13, 14]
    assert {r["RaceYear"] for r in new["Season"].collect()} == {2021}
    races = {(r["RaceYear"], r["NrOfRound"]): r for r in new["Race"].collect()}
    assert set(races) == {(2021, 14), (2021, 19)}                 # round 10 exists
    assert races[(2021, 14)]["RaceDate"] == dt.date(2021, 12, 31)
    res = new["Result"].collect()
    assert len(res) == 8                                          # Hamilton at Silverstone exists
    assert sorted(r["ResultId"] for r in res) == list(range(501, 509))

    # second run against the grown tables adds nothing
    grown = {k: tables[k].unionByName(new[k], allowMissingColumns=True) for k in tables}
    again = ingest_race_results(stage, grown, race_date="2021-12-31")
    assert all(again[k].count() == 0 for k in again)


def test_unknown_car_defaults_once(spark):
    staged, _ = tolerant_load(spark, DIRTY)
    tables = _tables(spark)
    first = ingest_race_results(staged, tables)
    assert "UNKNOWN" in {r["ContstructorName"] for r in first["Constructor"].collect()}
    grown = {k: tables[k].unionByName(first[k], allowMissingColumns=True) for k in tables}
    second = ingest_race_results(staged, grown)
    assert second["Constructor"].count() == 0


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000, 1, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 5000)
    offset = spark.createDataFrame([(41,)], "m long")
    got = dense_index(df, ["k"], out="sid", offset=offset).select("k", "sid").collect()
    assert sorted((r["k"], r["sid"]) for r in got) == [(k, k + 42) for k in range(5000)]


def test_literal_source_matches_file(spark):
    """The pasted literal of the reference parses like the file."""
    from podium.sources.delimited import literal_lines, tolerant_parse

    with open(CLEAN) as fh:
        text = fh.read()
    staged, rejects = tolerant_parse(literal_lines(spark, text))
    from_file = read_delimited(spark, CLEAN).withColumnRenamed("TIME/RETIRED", "TimeRetired")
    cols = ["RaceNr", "Circuit", "POS", "NO", "Driver", "Car", "Laps", "TimeRetired", "Points"]
    assert sorted(tuple(r) for r in staged.select(cols).collect()) == \
        sorted(tuple(r) for r in from_file.select(cols).collect())
    assert rejects.count() == 0


def test_ingest_job_appends_once(spark):
    """I1-I7 + S7 as a job over stored tables: the second run appends nothing."""
    from podium.plans.ingest_job import TABLES, run_ingest

    tables_dir = tempfile.mkdtemp(prefix="podium-tables-")
    seed = _tables(spark)
    for name in TABLES:
        seed[name].write.parquet(f"{tables_dir}/{name}")
    first, rejects = run_ingest(spark, DIRTY, tables_dir, race_date="2021-12-31")
    assert first["Result"] > 0 and first["Driver"] > 0
    assert rejects.count() == 2
    again, _ = run_ingest(spark, DIRTY, tables_dir, race_date="2021-12-31")
    assert all(v == 0 for v in again.values())
    assert spark.read.parquet(f"{tables_dir}/Result").count() == 1 + first["Result"]


def _store(spark):
    from podium.plans.ingest_job import TABLES
    from podium.sources.sinks import fresh_folder
    from podium.sources.snapshots import Snapshots

    store = Snapshots(spark, fresh_folder(spark, "test-ingest"))
    seed = _tables(spark)
    store.create({name: seed[name] for name in TABLES})
    return store


def test_ingest_into_a_store_is_one_commit(spark):
    """The same rows as the job over folders, in one version; the second run makes none."""
    from podium.plans.ingest_job import TABLES, run_ingest, run_ingest_as_one

    store, tables_dir = _store(spark), tempfile.mkdtemp(prefix="podium-tables-")
    for name in TABLES:
        _tables(spark)[name].write.parquet(f"{tables_dir}/{name}")
    first, rejects = run_ingest_as_one(spark, DIRTY, store, race_date="2021-12-31")
    assert first == run_ingest(spark, DIRTY, tables_dir, race_date="2021-12-31")[0] and rejects.count() == 2
    assert store.version() == 2
    for name in TABLES:
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, spark.read.parquet(f"{tables_dir}/{name}").collect()))
    again, _ = run_ingest_as_one(spark, DIRTY, store, race_date="2021-12-31")
    assert not any(again.values()) and store.version() == 2


def test_ingest_lost_between_two_tables_leaves_the_old_state(spark, monkeypatch):
    from podium.plans.ingest_job import TABLES, run_ingest_as_one
    from podium.sources.snapshots import Snapshots

    store = _store(spark)
    before = {name: sorted(map(str, store.read(name).collect())) for name in TABLES}
    real = Snapshots.put_aside

    def lost(self, table, df, **how):
        if table == "Result":  # races, drivers and the others are written by now
            raise RuntimeError("the job is lost")
        return real(self, table, df, **how)
    monkeypatch.setattr(Snapshots, "put_aside", lost)
    with pytest.raises(RuntimeError):
        run_ingest_as_one(spark, DIRTY, store, race_date="2021-12-31")
    assert {name: sorted(map(str, store.read(name).collect())) for name in TABLES} == before
    monkeypatch.setattr(Snapshots, "put_aside", real)
    first, _ = run_ingest_as_one(spark, DIRTY, store, race_date="2021-12-31")
    results = [(r.RaceId, r.DriverId) for r in store.read("Result").collect()]
    assert first["Result"] > 0 and len(results) == len(set(results)) == len(before["Result"]) + first["Result"]
