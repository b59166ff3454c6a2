"""The reference's trigger tests (R1-R4), table-driven (FIXTURES.md section 3).

Each case applies one statement (insert or update) to a seeded state and checks
the rule on the touched groups, like the AFTER trigger. Unlike the reference's
"should fail" tests, which cannot fail, these assert the specific violation.
"""

import pytest

from podium.operators import rules as R
from podium.operators.overlay import overlay_rows
from tests.helpers import races, results

R1 = R.position_rule()  # from 1962
R2 = R.driver_rule()    # from 1979
R4 = R.number_owner_rule()  # from 2014


def _state(spark, base_rows, change_rows, update):
    base = results(spark, base_rows)
    change = results(spark, change_rows)
    state = overlay_rows(base, change, "ResultId") if update else base.unionByName(change)
    return state, change


def _result_rule(spark, rule, year, base_rows, change_rows, update=False, **kw):
    state, change = _state(spark, base_rows, change_rows, update)
    race = races(spark, [(900000, year), (900001, year)])
    rows = R.with_season(state, race)
    touched = R.with_season(change, race) if isinstance(rule, R.OwnerRule) else change
    return R.violations(rule, rows, touched, **kw).collect()


# (name, year, base, statement rows, update?, expect violation?)   rows: (ResultId, RaceId, DriverId, Position)
R1_CASES = [
    ("01 positions 1 then 2", 2030, [(900000, 900000, 900000, 1)], [(900001, 900000, 900001, 2)], False, False),
    ("02 position 1 twice before gate", 1600, [(900000, 900000, 900000, 1)], [(900001, 900000, 900001, 1)], False, False),
    ("03 position 1 twice", 2030, [(900000, 900000, 900000, 1)], [(900001, 900000, 900001, 1)], False, True),
    ("04 one statement before gate", 1600, [], [(900000, 900000, 900000, 1), (900001, 900000, 900001, 1)], False, False),
    ("05 one statement", 2030, [], [(900000, 900000, 900000, 1), (900001, 900000, 900001, 1)], False, True),
    ("06 update 2 to 3", 2030, [(900000, 900000, 900000, 1), (900001, 900000, 900001, 2)],
     [(900001, 900000, 900001, 3)], True, False),
    ("07 update 2 to 1", 2030, [(900000, 900000, 900000, 1), (900001, 900000, 900001, 2)],
     [(900001, 900000, 900001, 1)], True, True),
]


@pytest.mark.parametrize("name,year,base,change,update,bad", R1_CASES, ids=[c[0] for c in R1_CASES])
def test_r1_position_unique(spark, name, year, base, change, update, bad):
    v = _result_rule(spark, R1, year, base, change, update)
    assert bool(v) == bad
    if bad:
        assert v[0]["Message"] == "Duplicate position detected: RaceId = 900000, Position = 1, Count = 2"


R2_CASES = [
    ("01 two drivers", 2030, [(900000, 900000, 900000, 1)], [(900001, 900000, 900001, 2)], False, False),
    ("02 same driver before gate", 1600, [(900000, 900000, 900000, 1)], [(900001, 900000, 900000, 2)], False, False),
    ("03 same driver", 2030, [(900000, 900000, 900000, 1)], [(900001, 900000, 900000, 2)], False, True),
    ("04 one statement before gate", 1600, [], [(900000, 900000, 900000, 1), (900001, 900000, 900000, 2)], False, False),
    ("05 one statement", 2030, [], [(900000, 900000, 900000, 1), (900001, 900000, 900000, 2)], False, True),
    ("06 update to third driver", 2030, [(900000, 900000, 900000, 1), (900001, 900000, 900001, 2)],
     [(900001, 900000, 900002, 2)], True, False),
    ("07 update to other row's driver", 2030, [(900000, 900000, 900000, 1), (900001, 900000, 900001, 2)],
     [(900001, 900000, 900000, 2)], True, True),
]


@pytest.mark.parametrize("name,year,base,change,update,bad", R2_CASES, ids=[c[0] for c in R2_CASES])
def test_r2_driver_unique(spark, name, year, base, change, update, bad):
    v = _result_rule(spark, R2, year, base, change, update)
    assert bool(v) == bad
    if bad:
        assert v[0]["Message"] == "Duplicate driver detected: RaceId = 900000, DriverId = 900000, Count = 2"


def test_r2_touched_groups_flags_old_duplicate(spark):
    """Trap T16: the reference's two IN lists flag an untouched old duplicate."""
    base = [(1, 900000, 7, 1), (2, 900000, 7, 2), (3, 900001, 8, 1)]
    change = [(4, 900000, 8, 3), (5, 900001, 7, 2)]  # touches race 900000 and driver 7, not the pair
    assert _result_rule(spark, R2, 2030, base, change, touch_mode="pairwise") == []
    v = _result_rule(spark, R2, 2030, base, change, touch_mode="touched_groups")
    assert [(r["RaceId"], r["DriverId"]) for r in v] == [(900000, 7)]


def _cap(spark, base_rows, change_rows, update):
    base = races(spark, base_rows)
    change = races(spark, change_rows)
    state = overlay_rows(base, change, "RaceId") if update else base.unionByName(change)
    return R.violations(R.season_cap_rule(25), state, change).collect()


def _season(year, n, start=1):
    return [(year * 1000 + i, year, i) for i in range(start, start + n)]


R3_CASES = [
    ("01 24 plus 1", _season(2030, 24), [(2030025, 2030, 25)], False, False),
    ("02 25 plus 1", _season(2030, 25), [(2030026, 2030, 26)], False, True),
    ("03 rename a race", _season(2030, 25), [(2030001, 2030, 1)], True, False),
    ("04 move into season with 10", _season(2030, 25) + _season(2031, 10), [(2030001, 2031, 11)], True, False),
    ("05 move into season with 25", _season(2030, 25) + _season(2031, 25), [(2030001, 2031, 26)], True, True),
    ("06 25 and 5", [], _season(2030, 25) + _season(2031, 5), False, False),
]


@pytest.mark.parametrize("name,base,change,update,bad", R3_CASES, ids=[c[0] for c in R3_CASES])
def test_r3_season_cap(spark, name, base, change, update, bad):
    v = _cap(spark, base, change, update)
    assert bool(v) == bad
    if bad:
        assert v[0]["Message"] == "Season with more than 25 races detected: RaceYear = 2031" or \
            v[0]["Message"] == "Season with more than 25 races detected: RaceYear = 2030"


def _owner(spark, race_rows, base_rows, change_rows, update=False):
    state, change = _state(spark, base_rows, change_rows, update)
    race = races(spark, race_rows)
    return R.violations(R4, R.with_season(state, race), R.with_season(change, race)).collect()


R4_CASES = [
    ("00 same driver two races", [(1, 2030), (2, 2030)], [(10, 1, 7, 1, 44)], [(11, 2, 7, 1, 44)], False, False),
    ("01 two drivers one season", [(1, 2030), (2, 2030)], [(10, 1, 7, 1, 44)], [(11, 2, 8, 1, 44)], False, True),
    ("02 two drivers two seasons", [(1, 2030), (2, 2031)], [(10, 1, 7, 1, 44)], [(11, 2, 8, 1, 44)], False, False),
    ("03 before the gate", [(1, 2000), (2, 2000)], [(10, 1, 7, 1, 44)], [(11, 2, 8, 1, 44)], False, False),
    ("04 update 33 to 44", [(1, 2030)], [(10, 1, 7, 1, 44), (11, 1, 8, 2, 33)], [(11, 1, 8, 2, 44)], True, True),
    ("05 update 33 to 55", [(1, 2030)], [(10, 1, 7, 1, 44), (11, 1, 8, 2, 33)], [(11, 1, 8, 2, 55)], True, False),
]


@pytest.mark.parametrize("name,race_rows,base,change,update,bad", R4_CASES, ids=[c[0] for c in R4_CASES])
def test_r4_number_owner(spark, name, race_rows, base, change, update, bad):
    v = _owner(spark, race_rows, base, change, update)
    assert bool(v) == bad
    if bad:
        assert v[0]["Message"] == "ResultNumber already used by another driver in this season"


def test_null_position_and_number_are_exempt(spark):
    assert _result_rule(spark, R1, 2030, [(1, 900000, 7, None)], [(2, 900000, 8, None)]) == []
    assert _owner(spark, [(1, 2030)], [(10, 1, 7, 1, None)], [(11, 1, 8, 2, None)]) == []
