"""Plan expectations: each remark on the reference's plans becomes
an assertion on Spark's physical plan."""

import re

import pytest

import __spark_entry__ as E
from podium.operators.keys import dense_index
from tests.conftest import SF_SMALL

QUERIES = E.queries()


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()          # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_top1_is_limited_before_the_shuffle(spark):
    plan = QUERIES["q2_fastest_first"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_number_owner_is_grouped_not_pairwise(spark):
    plan = _plan(QUERIES["r4_number_owner"](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cartesian(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert bad not in plan, bad


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(QUERIES["q1_min_completion"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    lineitem = [s for s in schemas if "l_quantity" in s]
    assert lineitem and all("l_comment" not in s and "l_tax" not in s for s in lineitem)
    r1 = _plan(QUERIES["r1_dup_position"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_linenumber)" in r1


def test_dense_index_has_no_global_window_over_rows(spark):
    df = spark.range(0, 20000, 1, 8).withColumnRenamed("id", "k")
    plan = _plan(dense_index(df, ["k"], out="sid"))
    # the only single-partition step is the per-partition offset table (one row per partition)
    windows = re.findall(r"Window \[[^\]]*\]", plan)
    assert "ExistingRDD" in plan          # numbered rows come from the checkpoint: lineage cut
    assert len(windows) <= 1


def test_touched_groups_use_semi_joins(spark):
    plan = _plan(QUERIES["u1_create"](spark, SF_SMALL))
    assert "LeftSemi" in plan


def test_unbroken_lead_needs_no_two_level_correlation(spark):
    plan = _plan(QUERIES["q3_unbroken_lead"](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan


def test_season_filters_reach_the_scan(spark):
    """SURVEY 4: a year(date) predicate cannot prune row groups; the binding adds the
    equivalent range on the raw date, which parquet receives as pushed filters."""
    for name in ("q1_min_completion", "q2_fastest_first"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:2] in ("q1", "q2", "q3", "q4", "q5", "q6", "q7",
                                                                          "r1", "r2", "r3", "r4")))
def test_questions_never_funnel_into_one_partition(spark, name):
    """No question or rule check gathers its rows into a single task (the only
    single-partition steps in the library are one-row counts and per-partition offsets)."""
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "SinglePartition" not in plan
