"""Every registered query against its DuckDB oracle at sf0.001 (the driver's check runs sf0.01)."""

import os
import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from podium.plans.catalog import all_queries
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, rows_of

QUERIES = {name: fn for name, fn in E.queries().items() if name in all_queries()}
ORACLES = {name: sql for name, sql in E.oracle_sql().items() if name in all_queries()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='podium-duck-')}'")
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, want)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
