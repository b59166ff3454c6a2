"""Q2: the fastest result per group (fastest lap per race) with context.

Two tie policies (trap T2): ``ties="first"`` keeps one row per race, broken by
the tie-break columns (options 1/2); ``ties="all"`` keeps every row equal to the
minimum (option 3, J4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fastest_per_group(results: DataFrame, *, group: str, value: str,
                      tiebreak: Sequence[str] = (), ties: str = "first") -> DataFrame:
    """Rows of ``results`` holding the smallest non-NULL ``value`` per ``group``.

    first: ``row_number() == 1`` (W2 + P10). Catalyst plans a partial
    ``WindowGroupLimit`` before the shuffle, so each map task forwards at most one
    row per group - a hot group costs no more than a cold one.
    all: per-group ``min`` (partial aggregate) joined back on (group, value).
    The tie-break columns of "first" must make the order total; without any the choice among
    ties would differ between runs, so they are required.
    """
    if ties == "first" and not tiebreak:
        raise ValueError("ties='first' needs tie-break columns")
    present = results.filter(F.col(value).isNotNull())  # P5
    if ties == "first":
        w = Window.partitionBy(group).orderBy(F.col(value), *[F.col(c) for c in tiebreak])
        return (present.withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") == 1).drop("_rn"))
    if ties == "all":
        best = present.groupBy(group).agg(F.min(value).alias(value))
        return present.join(best, [group, value])
    raise ValueError(f"unknown ties policy {ties!r}")


def first_per_group_scalar(groups: DataFrame, results: DataFrame, *, group: str, value: str,
                           tiebreak: Sequence[str]) -> DataFrame:
    """Option 1 / O4: every row of ``groups`` with the columns of its fastest result, or NULLs.

    The correlated ``(SELECT TOP 1 ... ORDER BY)`` becomes the top-1 row per group (limited
    on the scan's side) and a left join, so groups without a timed result keep
    NULLs. The whole row is carried, so the results are not read again to look it up by key.
    """
    best = fastest_per_group(results, group=group, value=value, tiebreak=tiebreak, ties="first")
    return groups.join(best, group, "left")
