"""The analytic operators on hand-made mini inputs (FIXTURES.md section 4): text
formats of the golden outputs and the traps where the reference's formulations
disagree (SURVEY 6.2)."""


from pyspark.sql import functions as F

from podium.functions import (
    after_first_word, first_word, full_name, hundredths_of_percent, nth_part,
    percent_text_fixed, percent_text_trimmed, strict_name, whole_percent,
)
from podium.operators.completion import min_completion
from podium.operators.fastest import fastest_per_group
from podium.operators.periods import active_periods
from podium.operators.shares import career_wins, season_win_share
from podium.operators.standings import build_standings, final_standings, season_champions

RACE = "RaceId int, RaceYear int, NrOfRound int, RaceDate string, RaceName string"
DRIVER = "DriverId int, Firstname string, Lastname string"


def test_percent_texts(spark):
    rows = [(105, 356), (91, 308), (27, 100), (32, 404), (19, 22), (1, 1), (0, 5), (1, 0)]
    df = spark.createDataFrame(rows, "w long, n long").withColumn("h", hundredths_of_percent("w", "n"))
    got = [(r["t"], r["f"]) for r in df.select(percent_text_trimmed("h").alias("t"),
                                                percent_text_fixed("h").alias("f")).collect()]
    assert got == [("29.49%", "29.49%"), ("29.55%", "29.55%"), ("27%", "27.00%"), ("7.92%", "7.92%"),
                   ("86.36%", "86.36%"), ("100%", "100.00%"), ("0%", "0.00%"), (None, None)]
    # half up on the exact value, not on a binary approximation: 100*201/20000 = 1.005
    assert spark.createDataFrame([(201, 20000)], "w long, n long").select(
        percent_text_fixed(hundredths_of_percent("w", "n"))).first()[0] == "1.01%"
    assert spark.range(1).select(whole_percent(F.lit(49), F.lit(50)).alias("p")).first()["p"] == 98


def test_names_and_parts(spark):
    df = spark.createDataFrame([("Max Verstappen",), ("Tsunoda",), ("Jean Eric Vergne",)], "n string")
    got = df.select(first_word("n"), after_first_word("n")).collect()
    assert [tuple(r) for r in got] == [("Max", "Verstappen"), ("Tsunoda", ""), ("Jean", "Eric Vergne")]
    names = spark.createDataFrame([("A", None), ("A", "B")], "f string, l string")
    assert [tuple(r) for r in names.select(full_name("f", "l"), strict_name("f", "l")).collect()] == \
        [("A", None), ("A B", "A B")]
    parts = spark.createDataFrame([("202114;Monza;1",)], "s string")
    assert tuple(parts.select(nth_part("s", ";", 2), nth_part("s", ";", 4)).first()) == ("Monza", None)


def test_q1_one_race_driver_and_zero_laps(spark):
    races = spark.createDataFrame([(1, 2024, 1, "", ""), (2, 2024, 2, "", ""), (3, 2024, 3, "", ""),
                                   (4, 2023, 1, "", "")], RACE)
    results = spark.createDataFrame(
        [(1, 10, 58), (1, 11, 57), (2, 10, 50), (2, 11, 40), (3, 12, 0), (3, 13, 0), (1, 14, 58), (4, 11, 1)],
        "RaceId int, DriverId int, Laps int")
    drivers = spark.createDataFrame([(10, "Oscar", "Piastri"), (11, "Lando", "Norris"), (12, "A", "B"),
                                     (13, "C", "D"), (14, "Oliver", "Bearman")], DRIVER)
    for method in ("aggregate", "window"):
        got = {r["Name"]: r["Completion"] for r in
               min_completion(results, races, drivers, season_value=2024, method=method).collect()}
        # one-race drivers qualify (T6); a race whose max laps is 0 has no completion
        assert got == {"Oscar Piastri": "100%", "Oliver Bearman": "100%"}


def test_q2_tie_policies(spark):
    res = spark.createDataFrame([(1, 5, 80.1), (1, 6, 80.1), (1, 7, 81.0), (2, 5, None), (3, 8, 79.0)],
                                "RaceId int, DriverId int, LapTime double")
    first = fastest_per_group(res, group="RaceId", value="LapTime", tiebreak=("DriverId",), ties="first")
    every = fastest_per_group(res, group="RaceId", value="LapTime", ties="all")
    assert sorted((r["RaceId"], r["DriverId"]) for r in first.collect()) == [(1, 5), (3, 8)]
    assert sorted((r["RaceId"], r["DriverId"]) for r in every.collect()) == [(1, 5), (1, 6), (3, 8)]


def test_q4_islands(spark):
    years = [(1, y) for y in (2007, 2008, 2009, 2010, 2011, 2013, 2014)] + [(2, 1952)] + \
            [(3, y) for y in (1975, 1976, 1977, 1978, 1979, 1980, 1981, 1983, 1985, 1986)] + [(1, 2009)]
    pairs = spark.createDataFrame(years, "DriverId int, RaceYear int")
    for method in ("rank", "lag"):
        got = {r["DriverId"]: (r["Ranges"], r["Periods"]) for r in active_periods(pairs, method=method).collect()}
        assert got == {1: ("2007-2011, 2013-2014", 2), 2: ("1952", 1), 3: ("1975-1981, 1983, 1985-1986", 3)}


def test_q5_q6_counts(spark):
    races = spark.createDataFrame([(1, 2020, 1, "", ""), (2, 2020, 2, "", ""), (3, 2021, 1, "", "")], RACE)
    res = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (1, 8, 2), (2, 8, 1), (3, 8, 2)],
                                "RaceId int, DriverId int, Position int")
    share = {(r["DriverId"], r["RaceYear"]): (r["Races"], r["Wins"], r["Hundredths"])
             for r in season_win_share(res, races).collect()}
    assert share == {(7, 2020): (2, 1, 5000), (7, 2021): (1, 1, 10000), (8, 2020): (2, 1, 5000),
                     (8, 2021): (1, 0, 0)}
    career = {r["DriverId"]: (r["Entries"], r["Wins"]) for r in career_wins(res, min_wins=2).collect()}
    assert career == {7: (3, 2)}


def _championship(spark):
    """Season 2015: A leads from round 1 and never loses it; season 2016: B wins the
    title without winning a round and leads unbroken from round 2; round 4 of 2016
    has no results at all (dense standings keep everyone)."""
    races = spark.createDataFrame(
        [(201501, 2015, 1, "2015-03-01", "R1"), (201502, 2015, 2, "2015-04-01", "R2"),
         (201601, 2016, 1, "2016-03-01", "R1"), (201602, 2016, 2, "2016-04-01", "R2"),
         (201603, 2016, 3, "2016-05-01", "R3"), (201604, 2016, 4, "2016-06-01", "R4")], RACE)
    pts = spark.createDataFrame(
        [(201501, 1, 10.0, 1, "X"), (201501, 2, 5.0, 2, "Y"), (201502, 1, 8.0, 1, "X"), (201502, 2, 1.0, 2, "Y"),
         (201601, 3, 10.0, 1, "Z"), (201601, 2, 9.0, 2, "Y"), (201602, 4, 10.0, 1, "Z"), (201602, 2, 9.0, 2, "Y"),
         (201603, 5, 10.0, 1, "Z"), (201603, 2, 9.0, 2, "Y")],
        "RaceId int, DriverId int, Points double, Position int, ConstructorName string")
    return races, pts


def test_standings_are_dense(spark):
    races, pts = _championship(spark)
    st = build_standings(pts.select("RaceId", "DriverId", "Points"), races)
    rows = {(r["RaceId"], r["DriverId"]): (r["Points"], r["Position"]) for r in st.collect()}
    assert rows[(201502, 2)] == (6.0, 2)
    assert rows[(201604, 2)] == (27.0, 1)          # no results in round 4, still standing
    assert rows[(201601, 4)] == (0.0, 3)           # entrant before first scoring; 0-point tie broken by id
    assert len(rows) == 2 * 2 + 4 * 4


def test_q3_champions_traps(spark):
    races, pts = _championship(spark)
    st = build_standings(pts.select("RaceId", "DriverId", "Points"), races)
    got = {r["RaceYear"]: (r["DriverId"], r["RaceWins"], r["TotaalRaces"], r["Volgnummer"], r["LeiderVanaf"])
           for r in season_champions(st, races, pts).collect()}
    # Led from round 1 - kept; T9: champion without a win - 0 wins, kept; T10: races counted
    assert got == {2015: (1, 2, 2, 1, "2015-03-01"), 2016: (2, 0, 4, 2, "2016-04-01")}


def test_q7_last_race_with_standings(spark):
    races, pts = _championship(spark)
    # a later round without standings must not empty the report (T5)
    later = spark.createDataFrame([(201605, 2016, 5, "2016-07-01", "Sprint")], RACE)
    st = build_standings(pts.select("RaceId", "DriverId", "Points"), races)
    pts_r = pts.withColumn("ResultId", F.col("RaceId") * 10 + F.col("DriverId"))
    final = final_standings(st, races.unionByName(later), pts_r, seasons=[2016])
    rows = {r["DriverId"]: (r["RaceId"], r["Position"], r["ConstructorName"]) for r in final.collect()}
    # round 4 had no results, so nobody has a car there (T13: left join keeps the row)
    assert rows[2] == (201604, 1, None)
    assert set(rows) == {2, 3, 4, 5}


def test_time_text(spark):
    from podium.functions import time_text

    df = spark.createDataFrame([(79_813_000,), (3_723_000_001,), (0,)], "us long")
    assert [r[0] for r in df.select(time_text("us")).collect()] == [
        "00:01:19.8130000", "01:02:03.0000010", "00:00:00.0000000"]
