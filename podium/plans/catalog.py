"""All registered queries and their DuckDB oracles, by name.

Names start with the SURVEY section 2 id they exercise (q1_..., r1_..., u1_...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podium.plans import (
    analytics, championship, feeds, integrity, layouts, loading, oracle, scalars, streams,
)

QueryFn = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for module in (analytics, championship, feeds, integrity, loading, layouts, streams, scalars):
        out.update(module.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    return dict(oracle.ORACLE)
