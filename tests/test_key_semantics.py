"""Cases with repeated keys, tied sequence numbers, existing ids, namesakes and unresolved lines."""

import pytest
from pyspark.sql import functions as F

from podium.functions.text import idiv
from podium.operators import ingest
from podium.operators import rules as R
from podium.operators import upsert as U
from podium.operators.fastest import fastest_per_group
from podium.operators.overlay import overlay_rows, update_columns
from podium.plans.feeds import TABLE_DDL
from podium.plans.publish_job import apply_and_publish
from podium.sources.sinks import ConstraintViolation, fresh_folder, input_fingerprint, path_exists
from tests.helpers import RESULT_DDL, empty_results, races, results

RACES = [(900000, 2030), (900001, 2030, 2)]


def batch(spark, rows):
    """rows: (seq, ResultId, RaceId, DriverId, Position[, ResultNumber])."""
    return spark.createDataFrame([(r[1], r[2], r[3], r[4], r[5] if len(r) > 5 else None, r[0]) for r in rows], RESULT_DDL + ", seq int")


def outcome(report, key="ResultId"):
    return sorted((r[key], r["Status"], r["Error"]) for r in report.collect())


def test_tied_sequence_numbers_accept_one_row(spark):
    rep = U.create_unique(empty_results(spark), batch(spark, [(1, 2, 900000, 5, 1), (1, 1, 900000, 6, 1)]), races(spark, RACES), R.position_rule())
    assert outcome(rep) == [(1, "accepted", None), (2, "rejected", R.MSG_POSITION_TAKEN)]


def test_tied_sequence_numbers_under_the_cap(spark):
    base = races(spark, [(i, 2030, i) for i in range(24)]).select("RaceId", "RaceYear")
    new = spark.createDataFrame([(100, 2030, 7), (101, 2030, 7)], "RaceId int, RaceYear int, seq int")
    rep = U.create_capped(base, new, R.season_cap_rule())
    assert [(k, s) for k, s, _ in outcome(rep, "RaceId")] == [(100, "accepted"), (101, "rejected")]


def test_existing_repeated_and_orphaned_keys_are_refused(spark):
    base = results(spark, [(1, 900000, 5, 1)])
    drivers = spark.createDataFrame([(5,), (6,)], "DriverId int")
    rows = [(1, 1, 900000, 6, 9), (2, 2, 900000, 6, 2), (3, 2, 900000, 6, 3), (4, 4, 900000, 77, 4), (5, 5, 900000, 6, 2)]
    rep = U.create_unique(base, batch(spark, rows), races(spark, RACES), R.position_rule(), parents={"DriverId": (drivers, "DriverId")})
    assert outcome(rep) == [
        (1, "rejected", R.MSG_KEY_EXISTS), (2, "rejected", R.MSG_KEY_REPEATED), (2, "rejected", R.MSG_KEY_REPEATED),
        (4, "rejected", "Driver does not exist"), (5, "accepted", None)]  # the refused rows claim no place


def test_an_update_given_twice_is_refused(spark):
    base = results(spark, [(1, 900000, 5, 1), (2, 900000, 6, 2)])
    twice = batch(spark, [(1, 1, 900000, 5, 3), (2, 1, 900000, 5, 4)]).drop("seq")
    rep = U.update_results(base, twice, races(spark, RACES), R.position_rule())
    assert {e for _, _, e in outcome(rep)} == {R.MSG_KEY_REPEATED}


def test_overlay_keeps_the_last_change(spark):
    base = results(spark, [(1, 900000, 5, 1), (2, 900000, 6, 2)])
    changes = batch(spark, [(1, 1, 900000, 5, 7), (3, 1, 900000, 5, 8), (2, 1, 900000, 5, 9)])
    got = {r.ResultId: r.Position for r in overlay_rows(base, changes, "ResultId", seq="seq").collect()}
    assert got == {1: 8, 2: 2} and overlay_rows(base, changes.drop("seq"), "ResultId").count() == 2
    got = [(r.ResultId, r.Position) for r in update_columns(base, changes, "ResultId", ["Position"], seq="seq").collect()]
    assert sorted(got) == [(1, 8), (2, 2)]


def test_publish_takes_the_touched_groups_from_the_new_state(spark):
    base = results(spark, [(1, 900000, 5, 1), (2, 900000, 6, 2)])
    partial = spark.createDataFrame([(2, 1)], "ResultId int, Position int")  # key and changed column only
    target = fresh_folder(spark, "publish_test")
    with pytest.raises(ConstraintViolation):
        apply_and_publish(base, partial, races(spark, RACES), [R.position_rule(), R.number_owner_rule()], target, columns=["Position"])
    assert not path_exists(spark, target)
    apply_and_publish(base, partial.withColumn("Position", F.lit(5)), races(spark, RACES), [R.position_rule()], target, columns=["Position"])
    assert sorted(r.Position for r in spark.read.parquet(target).collect()) == [1, 5]


def stage(spark, rows):
    return spark.createDataFrame(rows, "RaceNr int, Circuit string, POS int, NO int, Driver string, Car string, Laps int, TimeRetired string, Points int")


def test_namesakes_and_unresolved_lines(spark):
    tables = {name: spark.createDataFrame([], ddl) for name, ddl in TABLE_DDL.items()}
    tables["Driver"] = spark.createDataFrame([(9, "Max Power"), (4, "max power")], "DriverId int, DriverRef string").selectExpr(
        "DriverId", "DriverRef", "1 AS DriverNumber", "split(DriverRef, ' ')[0] AS Firstname", "split(DriverRef, ' ')[1] AS Lastname", "'X' AS Nationality")
    rows = [(203001, "Here", 1, 7, "Max Power", "Red", 10, "1:0", 5), (203001, "There", 2, 8, None, "RED", 10, "1:1", 4),
            (203002, None, 1, 8, "Ann Other", None, 10, "1:2", 3), (None, "Here", 1, 8, "Ann Other", "blue", 10, "1:2", 3)]
    for order in (rows, rows[::-1]):
        new = ingest.ingest_race_results(stage(spark, order), tables)
        assert [(r.RaceYear, r.NrOfRound, r.RaceName) for r in new["Race"].collect()] == [(2030, 1, "Here")]
        assert [r.ContstructorName for r in new["Constructor"].orderBy("ConstructorId").collect()] == ["blue", "RED", "UNKNOWN"]
        assert [(r.DriverId, r.Position) for r in new["Result"].collect()] == [(4, 1)]
        assert sorted((r.RaceNr or 0, r.reason) for r in new["Unresolved"].collect()) == [
            (0, "race number is missing"), (203001, "driver is missing"), (203001, "driver name is not unique, lowest id taken"),
            (203002, "race has no circuit")]


def test_ties_need_a_tie_break(spark):
    with pytest.raises(ValueError):
        fastest_per_group(empty_results(spark), group="RaceId", value="Position")


def test_division_is_exact(spark):
    big = (1 << 53) + 1
    got = spark.range(1).select(idiv(F.lit(big), F.lit(1)).alias("a"), idiv(F.lit(7), F.lit(2)).alias("b"), idiv(F.lit(7), F.lit(0)).alias("c")).first()
    assert tuple(got) == (big, 3, None)


def test_fingerprint_sees_nested_files(spark):
    folder = fresh_folder(spark, "fingerprint_test")
    spark.range(3).write.parquet(f"{folder}/a/b")
    one = input_fingerprint(spark, [folder])
    spark.range(4).write.mode("append").parquet(f"{folder}/a/b")
    assert input_fingerprint(spark, [folder]) != one
