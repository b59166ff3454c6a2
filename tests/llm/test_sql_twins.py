"""Registered text queries against their DuckDB SQL, and that every query runs, at sf0.001."""

import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from podium.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tools.oracle_check import rows_of

NAMES = ("documents", "benchmark", "conversations", "pages", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='podium-duck-')}'")
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())
