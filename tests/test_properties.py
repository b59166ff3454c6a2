"""Property checks (SURVEY 5 (d)) on random small inputs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from podium.operators import rules as R
from podium.operators import upsert as U
from podium.operators.keys import dense_index
from podium.operators.periods import season_islands
from tests.helpers import RESULT_DDL, races, results

SETTINGS = settings(max_examples=8, deadline=None)


@SETTINGS
@given(st.dictionaries(st.integers(1, 6), st.sets(st.integers(1990, 2010), min_size=1, max_size=12), min_size=1))
def test_islands_partition_the_seasons(spark, seasons):
    rows = [(d, y) for d, ys in seasons.items() for y in ys]
    islands = season_islands(spark.createDataFrame(rows, "DriverId int, RaceYear int")).collect()
    for d, ys in seasons.items():
        mine = sorted((r["FromYear"], r["ToYear"]) for r in islands if r["DriverId"] == d)
        covered = [y for lo, hi in mine for y in range(lo, hi + 1)]
        assert sorted(covered) == sorted(ys)                      # exact cover, no overlap
        assert all(b[0] > a[1] + 1 for a, b in zip(mine, mine[1:]))  # islands are maximal


@SETTINGS
@given(st.integers(0, 10_000))
def test_accepted_creates_leave_no_violation(spark, seed):
    rng = random.Random(seed)
    race_rows = [(r, rng.choice([1950, 2030])) for r in range(1, 5)]
    base = []
    for i in range(1, 12):        # a valid base: unique (race, position) where gated
        row = (i, rng.randint(1, 4), rng.randint(1, 5), rng.randint(1, 4))
        if all((b[1], b[3]) != (row[1], row[3]) for b in base):
            base.append(row)
    batch = [(100 + i, rng.randint(1, 4), rng.randint(1, 5), rng.choice([None, 1, 2, 3, 4]), None, i)
             for i in range(30)]
    race = races(spark, race_rows)
    report = U.create_unique(results(spark, base), spark.createDataFrame(batch, RESULT_DDL + ", seq int"),
                             race, R.position_rule())
    state = results(spark, base).unionByName(U.accepted_rows(report).drop("seq"))
    assert R.violations(R.position_rule(), R.with_season(state, race)).count() == 0


@SETTINGS
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=300, unique=True), st.integers(0, 50))
def test_dense_index_is_a_permutation(spark, keys, start):
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(3)
    offset = spark.createDataFrame([(start,)], "m long")
    got = {r["k"]: r["sid"] for r in dense_index(df, ["k"], out="sid", offset=offset).collect()}
    assert [got[k] for k in sorted(keys)] == list(range(start + 1, start + len(keys) + 1))


@SETTINGS
@given(st.integers(0, 10_000))
def test_distributed_rank_equals_window(spark, seed):
    """A hot round (most rows in one group) ranked without a per-group window."""
    from podium.operators.standings import rank_in_round

    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 6), e, float(rng.randint(0, 20))) for e in range(400)]
    df = spark.createDataFrame(rows, "RaceId int, DriverId int, Points double").repartition(4)
    a = {(r["RaceId"], r["DriverId"]): r["Position"]
         for r in rank_in_round(df, race="RaceId", points="Points", entity="DriverId").collect()}
    b = {(r["RaceId"], r["DriverId"]): r["Position"]
         for r in rank_in_round(df, race="RaceId", points="Points", entity="DriverId",
                                method="distributed").collect()}
    assert a == b
