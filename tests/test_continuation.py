"""Stored periods and standings that are continued equal a rebuild."""

import random

import pytest

from podium.operators.continuation import continue_periods, continue_standings, in_place
from podium.operators.periods import season_islands
from podium.operators.standings import build_standings

PAIR, ISLAND = "DriverId int, RaceYear int", "DriverId int, FromYear int, ToYear int"
RACE, POINT = "RaceId int, RaceYear int, NrOfRound int", "RaceId int, DriverId int, Points decimal(10,2)"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_periods_equal_a_rebuild(spark, seed):
    draw = random.Random(seed)
    pairs = sorted({(draw.randint(1, 12), draw.randint(1990, 2010)) for _ in range(110)})
    batch = [p for p in pairs if draw.random() < 0.25]  # seasons between, before and after the stored ones
    stored = season_islands(spark.createDataFrame([p for p in pairs if p not in batch], PAIR))
    known = draw.sample(pairs, 10)
    named = {d for d, _ in batch + known}
    changed = continue_periods(stored, spark.createDataFrame(batch * 2 + known + [(None, 2000), (3, None)], PAIR))
    assert {r.DriverId for r in changed.collect()} == named
    assert rows(in_place(stored, changed, "DriverId")) == rows(season_islands(spark.createDataFrame(pairs, PAIR)))


def test_periods_unite_neighbours_and_empty_batches_change_nothing(spark):
    stored = spark.createDataFrame([(1, 1990, 1992), (1, 1994, 1995), (1, 1999, 1999), (2, 2000, 2001)], ISLAND)
    assert rows(continue_periods(stored, spark.createDataFrame([(1, 1993)], PAIR))) == [(1, 1990, 1995), (1, 1999, 1999)]
    assert rows(continue_periods(stored, spark.createDataFrame([], PAIR))) == []
    assert rows(continue_periods(spark.createDataFrame([], ISLAND), spark.createDataFrame([(7, 2000), (7, 2001)], PAIR))) == [(7, 2000, 2001)]


@pytest.mark.parametrize("seed", range(4))
def test_standings_equal_a_rebuild(spark, seed):
    draw = random.Random(seed)
    races = [(100 * y + n, 2000 + y, n) for y in range(1, 6) for n in range(1, 7)]
    points = [(r, d, draw.randint(0, 9)) for r, y, n in races for d in range(1, 8)
              if draw.random() < 0.5 and (d != 7 or n > 4)]  # competitor 7 joins late
    points += draw.sample(points, 5)  # two results of one race
    held = {y: draw.choice([0, 2, 4, 6]) for y in range(2001, 2006)}
    old, new = [r for r in races if r[2] <= held[r[1]]], [r for r in races if r[2] > held[r[1]]]

    def of(part):
        ids = {r[0] for r in part}
        return spark.createDataFrame([(r, d, p) for r, d, p in points if r in ids], "RaceId int, DriverId int, Points int").selectExpr(
            "RaceId", "DriverId", "CAST(Points AS decimal(10,2)) AS Points"), spark.createDataFrame(part, RACE)
    stored = build_standings(*of(old))
    changed = continue_standings(stored, of(old)[1], *of(new))
    whole = build_standings(*of(races))
    assert rows(in_place(stored, changed, "RaceId")) == rows(whole)
    untouched = {r for r, y, _ in races if held[y] == 6}
    assert not untouched & {r.RaceId for r in changed.collect()}


def test_an_empty_batch_continues_nothing(spark):
    points, races = spark.createDataFrame([(1, 1, 5.0)], "RaceId int, DriverId int, Points double"), spark.createDataFrame([(1, 2000, 1)], RACE)
    stored = build_standings(points, races)
    assert continue_standings(stored, races, points.limit(0), races.limit(0)).count() == 0
    # a new round in which nobody scores repeats the points
    assert rows(continue_standings(stored, races, points.limit(0), spark.createDataFrame([(2, 2000, 2)], RACE))) == [(2, 1, 5.0, 1)]
