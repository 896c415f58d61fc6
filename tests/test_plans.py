"""Plan-shape checks: no Python UDF on hot paths, pushdown and pruning reach the scan,
bounded dimensions are broadcast, one Expand for the unpivot."""

import pytest

import __spark_entry__ as E
from weekcraft.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["weekly_matrix", "weekly_long", "trailing_series", "rank_all_weeks", "daily_pivot",
                                 "upsert_daily", "weekly_from_report", "sessions", "history_load"])
def test_no_python_udf(spark, key):
    p = plan_of(E.queries()[key](spark, SF))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_weekly_long_prunes_and_pushes(spark):
    from weekcraft.plans import matrix as M
    df = M.weekly_long(Tables(spark, SF))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p
    assert "l_returnflag" not in p and "l_comment" not in p  # column pruning
    assert p.count("Expand") >= 1  # one unpivot, no 18-branch union
    assert "Union" not in p


def test_dictionary_join_is_broadcast(spark):
    from weekcraft.functions.concepts import attach_concept_key
    df = spark.createDataFrame([("MDAT",)], "concept string")
    p = plan_of(attach_concept_key(df))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_rank_windows_are_partitioned(spark):
    """WIN-1 runs two-phase: the rows' window and that over the ranges' totals are both partitioned."""
    from weekcraft.operators.rank import value_ranks
    p = plan_of(value_ranks(spark.range(500).selectExpr("CAST(id % 90 AS DOUBLE) AS v"), ["v"], buckets=4))
    windows = [ln for ln in p.splitlines() if "Window [" in ln]
    assert len(windows) >= 2 and all("[_col" in ln for ln in windows)
    assert "SinglePartition" not in p


def test_rank_per_week_is_one_window(spark):
    p = plan_of(E.queries()["rank_per_week"](spark, SF)).split("== Initial Plan ==")[0]
    assert p.count("Window [") == 1 and "Expand" not in p


def test_concept_metric_cleans_spellings_of_sites_not_rows(spark):
    from weekcraft.plans.catalog import QUERIES
    plan = QUERIES["concept_metric"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {name: [len(x) - len(x.lstrip(" :+-")) for x in plan if name in x] for name in ("Aggregate", "Expand")}
    joins = [len(x) - len(x.lstrip(" :+-")) for x in plan if "Join LeftOuter" in x]
    # Between the rows (Expand) and the dictionary's joins, rows are summed by site and spelling.
    assert any(max(joins) < d < min(depth["Expand"]) for d in depth["Aggregate"])


def test_means_of_parts_are_means_of_rows(spark):
    from pyspark.sql import functions as F
    from weekcraft.operators import aggregates as A
    rows = spark.createDataFrame([("a", "x", 0.1), ("a", "x", 0.2), ("a", "y", None), ("a", "z", 1e14), ("b", "x", None), (None, None, 3.0)], "k string, part string, v double")
    want = rows.groupBy("k").agg(A.dec_avg("v").alias("m"))
    got = rows.groupBy("k", "part").agg(*A.dec_parts("v")).groupBy("k").agg(A.dec_avg_of_parts().alias("m"))
    assert {r["k"]: r["m"] for r in got.collect()} == {r["k"]: r["m"] for r in want.collect()} == {"a": (1e14 + 0.3) / 3, "b": None, None: 3.0}
