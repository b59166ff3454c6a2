"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASH = "_join_hash"


def join_on_hot_key(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner", *,
                    spread_nulls: bool = False) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``right`` with one row per key.

    ``right`` usually comes out of an aggregate on the same keys and is already
    partitioned by them; Spark then joins in that stage, and AQE cannot split the hot
    key's rows of ``left``, because it only splits joins whose both sides come straight from an
    exchange. The hash of the keys as one more join column gives both sides an exchange
    of their own. ``right`` is small where it is worth it, and AQE broadcasts it on
    its measured size. A key whose types differ (the join compares them as one type) stays out of the hash,
    since equal numbers of two types have different hashes. spread_nulls: left rows without a key do not meet in one partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    alike = [k for k in keys if left.schema[k].dataType.simpleString() == right.schema[k].dataType.simpleString()]
    hashed = [df.withColumn(_HASH, F.xxhash64(F.lit(0), *alike)) for df in (left, right)]
    if spread_nulls:  # a row without a key meets nobody: any partition will do
        no_key = reduce(operator.or_, [F.col(k).isNull() for k in keys])
        hashed[0] = left.withColumn(_HASH, F.when(no_key, F.xxhash64(*left.columns)).otherwise(F.xxhash64(F.lit(0), *alike)))
    return hashed[0].join(hashed[1], [*keys, _HASH], how).drop(_HASH)
