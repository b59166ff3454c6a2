"""Snapshot overlays: UPDATE without update-in-place.

Plain parquet has no MERGE, so an update produces the next snapshot as a
DataFrame: the rows, each with its change if it has one (one left join on the key). The key
is the table's primary key, so the join partitions are as even as the keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def last_change(changes: DataFrame, key: str | Sequence[str], seq: str | None = None) -> DataFrame:
    """One change per key, as a sequence of UPDATEs would leave it: the one with the greatest
    ``seq`` (ties, and a batch without ``seq``: the greatest by the columns' values, so that runs agree).
    The top-1 is limited on the scan's side of the shuffle."""
    rest = [c for c in changes.columns if c != seq]
    order = ([F.col(seq).desc()] if seq else []) + [F.col(c).desc() for c in rest]
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    return changes.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).select(*rest)


def overlay_rows(base: DataFrame, changes: DataFrame, key: str | Sequence[str], seq: str | None = None) -> DataFrame:
    """Full-row update ``UPDATE T SET <all columns> WHERE key = ...``.

    Change rows whose key is not in ``base`` update nothing (like an UPDATE that
    matches no row). Columns absent from ``changes`` become NULL, as the
    procedures' omitted arguments do. Of several changes of a key the last one holds
    (``last_change``), so a key never becomes two rows. Base and batch meet once.
    """
    keys = _keys(key)
    rest = [c for c in base.columns if c not in keys]
    chg = last_change(changes, keys, seq)
    chg = chg.select(*keys, *[(F.col(c) if c in chg.columns else F.lit(None)).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_hit"))
    joined = base.join(chg, keys, "left")
    return joined.select(*[c if c in keys else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def update_columns(base: DataFrame, changes: DataFrame, key: str | Sequence[str],
                   columns: Sequence[str], seq: str | None = None) -> DataFrame:
    """``UPDATE T SET c = chg.c ... FROM changes WHERE key matches`` for some columns.

    A left join on the key; rows without a change keep their values, and of several changes
    of a key the last one holds.
    """
    keys = _keys(key)
    wanted = [*keys, *columns] + ([seq] if seq else [])
    chg = last_change(changes.select(*wanted), keys, seq).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn(
        "_hit", F.lit(True))
    joined = base.join(chg, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return joined.select(*base.columns)


def update_where(base: DataFrame, condition: Column, assignments: Mapping[str, Column]) -> DataFrame:
    """S9 with a predicate: ``UPDATE T SET c = expr WHERE condition`` - no join at all."""
    out = base
    for c, value in assignments.items():
        out = out.withColumn(c, F.when(condition, value).otherwise(F.col(c)))
    return out
