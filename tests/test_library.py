"""Library pieces without a query key of their own (SURVEY §7.4 'tests only')."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcraft.functions import clean as C
from weekcraft.functions.sqlfuncs import register_sql_functions
from weekcraft.operators import merge as MG
from weekcraft.operators.reshape import conform
from weekcraft.plans import admin as AD
from weekcraft.plans import matrix as M
from weekcraft.sources import bindings as B


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT wc_clean_number('$ 1.234,56') a, wc_clean_number('abc') b, wc_clean_concept('(A)  Vacas  masa') c,"
                  " wc_fmt_es(1234.5D) d, wc_parse_day('7-9-2025') e, wc_company_code('96.7_x') f").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (1234.56, None, "Vacas masa", "1.234,50", dt.date(2025, 9, 7), "96.7")


def test_truncate_and_stamp(spark, tables):
    d = B.daily(tables).select("site_id", "day", "concept", "value", "row_no")
    assert MG.truncate(d).count() == 0 and MG.truncate(d).schema == d.schema
    target = d.filter(F.col("row_no") % 2 == 0).dropDuplicates(["site_id", "day", "concept"]).drop("row_no")
    batch = d.filter(F.col("row_no") % 2 == 1)
    up = MG.upsert(target, batch, ["site_id", "day", "concept"], {"value": "new"}, order_col="row_no",
                   changed_col="changed")
    now = dt.datetime(2026, 1, 1)
    st = MG.stamp_updated(up, "changed", "updated_at", now)
    n_changed = up.filter("changed").count()
    assert st.filter(F.col("updated_at") == F.lit(now)).count() == n_changed > 0


def test_run_maintenance(spark, tables):
    logs = B.upload_logs(tables)
    out = AD.run_maintenance(logs, {"logs": logs, "sites": B.sites(tables)}, "2001-08-01", 90).collect()
    assert [r.task for r in out] == ["retention_logs", "statistics_logs", "statistics_sites"]


def test_headers_sort_preview(spark, tables):
    m = M.weekly_matrix(tables)
    h = M.display_headers(m)
    assert [f.name for f in h.schema.fields][:2] == ["site", "dry_matter_per_cow"]
    cfg = spark.createDataFrame([("matrix_sort", '{"column": "price", "direction": "asc"}')], "key string, value string")
    rows = M.sort_from_config(m, cfg).collect()
    prices = [r.price for r in rows if not r.is_total and r.price is not None]
    assert prices == sorted(prices) and rows[-1].is_total
    bad = spark.createDataFrame([("matrix_sort", '{"column": "nope"}')], "key string, value string")
    assert M.sort_from_config(m, bad).collect()[-1].is_total
    assert M.preview(m, 3).count() == 3


def test_conform_widens_and_refuses_narrowing(spark):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()),
                           T.StructField("c", T.StringType())])
    out = conform(df, target)
    assert out.schema == target and out.first().c is None
    with pytest.raises(ValueError):
        conform(df, T.StructType([T.StructField("b", T.IntegerType())]))


def test_date_headers_and_json(spark):
    assert C.sort_date_headers(["2-1-2025", "x", "31-12-2024", "1-1-2025"]) == ["31-12-2024", "1-1-2025", "2-1-2025", "x"]
    assert C.is_date_header("7-9-2025") and not C.is_date_header("07/09/2025")
    r = spark.range(1).select(C.to_json_value(F.lit(3).alias("id"), F.lit("x").alias("k")).alias("j")).first()
    assert r.j == '{"id":3,"k":"x"}'


def test_parameterised_sql(spark, tables):
    df = tables.sql("SELECT s_suppkey, s_name FROM {supplier} WHERE s_nationkey = :n ORDER BY s_suppkey", {"n": 3})
    exp = [r.s_suppkey for r in tables.supplier.filter("s_nationkey = 3").orderBy("s_suppkey").collect()]
    assert [r.s_suppkey for r in df.collect()] == exp


def test_history_for_matrix(spark, tables):
    from weekcraft.plans.history import history_for_matrix
    h = B.history(tables).join(B.sites(tables).select(F.col("name").alias("site"), "company_id"), "site") \
        .join(B.companies(tables).select("company_id", F.col("name").alias("company")), "company_id")
    last = h.agg(F.max("day")).first()[0]
    out = history_for_matrix(h, last, 4, company="nation_3").collect()
    assert out and all(r.company == "NATION_3" for r in out)
    assert all(r.day >= last - dt.timedelta(days=28) for r in out)


def test_delete_period_facts(spark):
    w = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 1, 7)), (2, dt.date(2024, 1, 8), dt.date(2024, 1, 14))],
                              "site_id long, period_start date, period_end date")
    d = spark.createDataFrame([(1, dt.date(2024, 1, 3), "x", 1.0), (1, dt.date(2024, 1, 9), "x", 2.0),
                               (2, dt.date(2024, 1, 3), "x", 3.0)], "site_id long, day date, concept string, value double")
    kw, kd = MG.delete_period_facts(w, d, "2024-01-01", "2024-01-07")
    assert [r.site_id for r in kw.collect()] == [2]
    assert sorted((r.site_id, r.value) for r in kd.collect()) == [(1, 2.0), (2, 3.0)]
    _, kd_all = MG.delete_period_facts(w, d, "2024-01-01", "2024-01-07", all_days=True)
    assert sorted(r.value for r in kd_all.collect()) == [3.0]


def test_latest_period_and_moves_reach_daily_facts_and_dimension(spark):
    from weekcraft.plans import catalog
    weekly = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', DATE'2024-01-07'), (1, DATE'2024-01-08', DATE'2024-01-14'), "
                       "(2, DATE'2024-01-01', DATE'2024-01-07') AS t(site_id, period_start, period_end)")
    daily = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-07', 'a'), (1, DATE'2024-01-08', 'a'), (2, DATE'2024-01-08', 'a') AS t(site_id, day, concept)")
    kept_weekly, kept_daily = catalog._without_latest_period(weekly, daily)
    assert kept_weekly.count() == 2
    assert sorted((r["site_id"], r["day"].day) for r in kept_daily.collect()) == [(1, 7), (2, 8)]
    assert catalog._without_latest_period(weekly.limit(0), daily)[1].count() == 3
    undated = weekly.unionByName(spark.sql("SELECT 3 AS site_id, CAST(NULL AS DATE) AS period_start, CAST(NULL AS DATE) AS period_end"))
    assert catalog._without_latest_period(undated, daily)[0].count() == 3
    moved = {r["site_id"]: r["company_id"] for r in catalog.QUERIES["move_site_dimension"](spark, "/root/testdata/sf0.001").collect()}
    facts = catalog.QUERIES["move_site"](spark, "/root/testdata/sf0.001").select("site_id", "company_id").distinct().collect()
    assert facts and all(moved[r["site_id"]] == r["company_id"] for r in facts)
