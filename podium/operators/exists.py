"""Existence with a comparison beside the equality (J8, J10): ``[NOT] EXISTS (... WHERE a.key = b.key AND a.x < b.y)``.

A join on the key alone would make every pair of a key's rows and throw most away. But whether one row exists is
known from little: for an order comparison from the key's least or greatest value, for ``<>`` from both, and for a
range from the least value that is not below the range's start. The extremes are grouped (partially before
the shuffle) and joined in a way that splits a hot key; the next value comes from the distributed scan. No
step makes pairs or holds a key's rows in one task.

NULL compares as unknown, as in SQL: a row with a NULL key or value has no match, so it is not in the semi form
and it is in the anti form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.operators.hints import join_on_hot_key
from podium.operators.scan import last_seen, scan

#: comparison -> whether a left value compares so with some right value, from the least and the greatest of these
_FROM_EXTREMES = {
    "<": lambda x, least, most: x < most,
    "<=": lambda x, least, most: x <= most,
    ">": lambda x, least, most: x > least,
    ">=": lambda x, least, most: x >= least,
    "<>": lambda x, least, most: (x != least) | (x != most),
}


def exists_where(left: DataFrame, right: DataFrame, keys: str | Sequence[str], value: str, comparison: str, other: str, *,
                 anti: bool = False) -> DataFrame:
    """The rows of ``left`` for which ``right`` has (anti: has not) a row with the same ``keys`` and
    ``left.value <comparison> right.other``; comparison: ``<``, ``<=``, ``>``, ``>=`` or ``<>``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ends = right.groupBy(*keys).agg(F.min(other).alias("_least"), F.max(other).alias("_most"))
    joined = join_on_hot_key(left, ends, keys, "left")
    return _kept(joined, _FROM_EXTREMES[comparison](F.col(value), F.col("_least"), F.col("_most")), anti, left.columns)


def exists_between(left: DataFrame, right: DataFrame, keys: str | Sequence[str], low: Column, high: Column, other: str, *,
                   anti: bool = False) -> DataFrame:
    """The rows of ``left`` for which ``right`` has (anti: has not) a row with the same ``keys`` and ``other`` between
    ``low`` and ``high``, two expressions over ``left``, ends included."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = left.select(*keys, F.struct(*left.columns).alias("_row"), low.alias("_at"), high.alias("_until"), F.lit(1).alias("_asks"))
    values = right.select(*keys, F.col(other).alias("_at"), F.lit(0).alias("_asks")).where(F.col(other).isNotNull()).distinct()
    both = rows.unionByName(values.withColumn("_value", F.col("_at")), allowMissingColumns=True)
    # from the greatest value down, values before the rows that start there: the last value seen is the next one up
    seen = scan(both, keys, [F.col("_at").desc_nulls_last(), "_asks"], _next=last_seen("_value")).where(F.col("_asks") == 1)
    known = [F.col(k).isNotNull() for k in keys]
    found = F.col("_at").isNotNull() & (F.col("_next") <= F.col("_until"))
    for k in known:
        found = found & k
    return _kept(seen, found, anti, left.columns, "_row.")


def _kept(df: DataFrame, found: Column, anti: bool, columns: Sequence[str], prefix: str = "") -> DataFrame:
    found = F.coalesce(found, F.lit(False))
    return df.filter(~found if anti else found).select(*[F.col(f"{prefix}{c}") for c in columns])
