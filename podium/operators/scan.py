"""Running values inside groups without one task per group.

``SUM(x) OVER (PARTITION BY g ORDER BY o)`` puts all rows of a group in one task, and without
``PARTITION BY`` all rows of the table. Here the rows are range-partitioned and sorted by (group,
order), so a hot group lies over many neighbouring partitions, and each partition computes its running values
alone. What a partition needs from those before it is one small row: the values that its first group has
reached there. Every partition hands on the totals of its last group; running totals over these rows - one per
partition, so their number is bounded by the partition count - are the carries, which are stored and
broadcast. The sorted rows are stored once in the shared folder, so a lost executor cannot deal
them differently between the totals and the running values.

Any associative value can be carried: ``running_sum``, ``running_count``, ``running_min``, ``running_max``,
``previous`` (LAG) and ``last_seen`` (the latest non-NULL value up to the row).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.sources.sinks import materialize


@dataclass(frozen=True)
class Running:
    """A running value: how it is computed over a window, and how two stretches' values combine."""

    kind: str
    value: Column

    def total(self, place: str) -> Column:
        """The value of a whole stretch, as an aggregate."""
        if self.kind == "previous":
            return F.max_by(self.value, F.col(place))
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(place)))
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[self.kind](self.value)

    def inside(self, window) -> Column:
        """The value up to a row, inside its stretch."""
        if self.kind == "previous":
            return F.lag(self.value).over(window)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(upto)
        return self.total("").over(upto)

    def joined(self, before: Column, own: Column, first: Column) -> Column:
        """The value after two neighbouring stretches; NULL stands for an empty one. first: no row of the
        later stretch has come before."""
        if self.kind == "previous":
            return F.when(first, before).otherwise(own)
        if self.kind == "last":
            return F.coalesce(own, before)
        if self.kind in ("min", "max"):
            return (F.least if self.kind == "min" else F.greatest)(before, own)
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)


def _value(kind: str, value: Column | str) -> Running:
    return Running(kind, F.col(value) if isinstance(value, str) else value)


def running_sum(value: Column | str) -> Running:
    """SUM(value) up to the row; NULLs are skipped, NULL while there are only NULLs."""
    return _value("sum", value)


def running_count(value: Column | str | None = None) -> Running:
    """COUNT(value) up to the row; without a value, ROW_NUMBER()."""
    return _value("count", F.lit(1) if value is None else value)


def running_min(value: Column | str) -> Running:
    """MIN(value) up to the row."""
    return _value("min", value)


def running_max(value: Column | str) -> Running:
    """MAX(value) up to the row."""
    return _value("max", value)


def previous(value: Column | str) -> Running:
    """LAG(value): the value of the row before, NULL for a group's first row."""
    return _value("previous", value)


def last_seen(value: Column | str) -> Running:
    """The latest value that is not NULL, up to the row."""
    return _value("last", value)


def scan(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], **values: Running) -> DataFrame:
    """``df`` with one column per running value, in ``order`` inside each ``group``.

    group: column names; empty for one running value over the whole table. NULL is a group like
    any other. order: should make the rows of a group a total order; rows that tie come in some fixed
    order, and each row counts alone (ROWS, not RANGE). Columns of the values' names are replaced.
    """
    keys = [F.col(g) for g in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    names = list(values)
    # the values' inputs are computed beside the rows, so that the rows may be dropped or renamed below
    inputs = {f"_in_{n}": r.value for n, r in values.items()}
    held = {n: Running(r.kind, F.col(f"_in_{n}")) for n, r in values.items()}
    tagged = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select(*df.columns, *[c.alias(n) for n, c in inputs.items()], F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().alias("_place")), "scan")
    totals = tagged.groupBy("_part", *group).agg(
        F.max("_place").alias("_end"), *[r.total("_place").alias(f"_sum_{n}") for n, r in held.items()])
    # one row per partition from here on: its last group with what that group reaches there
    fields = [*group, *[f"_sum_{n}" for n in names]]
    tails = totals.groupBy("_part").agg(F.max_by(F.struct(F.lit(True).alias("_any"), *fields), "_end").alias("_tail")).select("_part", "_tail.*")
    along = Window.orderBy("_part")
    upto = Window.partitionBy(*group).orderBy("_part")
    carried = [_over_tails(held[n].kind, f"_sum_{n}", upto).alias(f"_from_{n}") for n in names]
    carry = tails.select(F.lead("_part").over(along).alias("_to"), *[F.col(g).alias(f"_g_{g}") for g in group], *carried).filter(F.col("_to").isNotNull())
    carry = materialize(carry, "scan_carry")
    on = F.col("_part") == F.col("_to")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inner = Window.partitionBy("_part", *group).orderBy("_place")
    own = tagged.withColumn("_first", F.row_number().over(inner) == 1)
    for n in names:
        own = own.withColumn(f"_own_{n}", held[n].inside(inner))
    out = own.join(F.broadcast(carry), on, "left")
    keep = [c for c in df.columns if c not in names]
    return out.select(*keep, *[held[n].joined(F.col(f"_from_{n}"), F.col(f"_own_{n}"), F.col("_first")).alias(n) for n in names])


def _over_tails(kind: str, total: str, window) -> Column:
    """A group's value after all tails up to this one."""
    if kind == "previous":
        return F.col(total)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kind == "last":
        return F.last(total, ignorenulls=True).over(upto)
    return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[kind](total).over(upto)
