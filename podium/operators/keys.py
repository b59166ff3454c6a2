"""Dense surrogate keys continuing from the current maximum.

``ROW_NUMBER() OVER (ORDER BY x) + MAX(id)`` with no partition runs in a single
task in Spark. Here the rows are range-partitioned and sorted on the key (every
partition holds a contiguous slice of the order), each row gets its position
inside its partition from ``monotonically_increasing_id`` (partition index in
the upper bits, row position in the lower 33), and a per-partition count gives
each partition its offset. The only single-task step sees one row per
partition. The tagged rows are checkpointed to the shared checkpoint folder so
that a lost executor cannot renumber them between the count and the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.hints import join_on_hot_key

_LOW_BITS = (1 << 33) - 1


def dense_index(df: DataFrame, order: Sequence[str | Column], *, out: str = "id",
                offset: DataFrame | None = None, checkpoint: bool = True) -> DataFrame:
    """Add ``out`` = 1..n in ``order`` (a total order), plus ``offset``.

    offset: an optional one-row DataFrame with one numeric column (e.g. the
    current ``MAX(id)``, NULL read as 0); it is cross-joined as a broadcast.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        # persist first: a reliable checkpoint writes in a second job, which then
        # reads the persisted rows instead of recomputing the sort
        staged = tagged.persist(StorageLevel.MEMORY_AND_DISK)
        tagged = staged.checkpoint(eager=True)
        staged.unpersist()
    tagged = (tagged.withColumn("_part", F.shiftright("_mid", 33))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to order globally
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_off")
    numbered = (tagged.join(F.broadcast(offsets), "_part")
                .withColumn(out, F.col("_off") + F.col("_local") + 1))
    if offset is not None:
        base = offset.select(F.coalesce(F.col(offset.columns[0]).cast("long"), F.lit(0)).alias("_base"))
        numbered = numbered.crossJoin(F.broadcast(base)).withColumn(out, F.col(out) + F.col("_base"))
        numbered = numbered.drop("_base")
    return numbered.drop("_mid", "_part", "_local", "_off")


def current_max(df: DataFrame, column: str) -> DataFrame:
    """``ISNULL((SELECT MAX(id) FROM T), 0)`` as a one-row DataFrame."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("_max"))


def group_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], *,
                     out: str = "rn") -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without one task per group.

    A window puts every row of a group in one task; a group holding a third of all
    rows would run alone. Here the rows are numbered globally in (group, order)
    order by ``dense_index`` - range partitioning splits a hot group over many
    partitions along its order keys - and each row's number is its global index
    minus its group's first index (a partial aggregate joined back on the group).
    ``order`` must make the order total within a group.
    """
    keys = [F.col(g) for g in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    indexed = dense_index(df, keys, out="_gidx")
    first = indexed.groupBy(*group).agg(F.min("_gidx").alias("_gfirst"))
    return (join_on_hot_key(indexed, first, list(group))
            .withColumn(out, F.col("_gidx") - F.col("_gfirst") + 1)
            .drop("_gidx", "_gfirst"))
