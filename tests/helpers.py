"""Tiny racing tables for rule and operator tests (FIXTURES.md section 3)."""

from __future__ import annotations

import datetime as dt

RACE_DDL = "RaceId int, RaceYear int, NrOfRound int, CircuitId int, RaceName string, RaceDate date"
RESULT_DDL = "ResultId int, RaceId int, DriverId int, Position int, ResultNumber int"


def races(spark, rows):
    """rows: (RaceId, RaceYear[, NrOfRound])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else 1, 900000, "Test race", dt.date(2030, 3, 2)) for r in rows]
    return spark.createDataFrame(full, RACE_DDL)


def results(spark, rows):
    """rows: (ResultId, RaceId, DriverId, Position[, ResultNumber])."""
    full = [(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else None) for r in rows]
    return spark.createDataFrame(full, RESULT_DDL)


def empty_results(spark):
    return spark.createDataFrame([], RESULT_DDL)
