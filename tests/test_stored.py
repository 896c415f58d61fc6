"""Stored history, mixed file versions, ordered exports, sketches, collation, readers and validators."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from weekcraft.functions.concepts import attach_by_collation
from weekcraft.functions.sqlfuncs import register_sql_functions
from weekcraft.operators import merge as MG
from weekcraft.plans import admin as AD
from weekcraft.plans import history as H
from weekcraft.plans import history_store as HS
from weekcraft.plans import margin_load as ML
from weekcraft.sources import bindings as B
from weekcraft.sources import reports as S

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["history_window", "week_detail", "day_detail", "history_by_date"])
def test_reads_of_the_stored_history_prune_weeks(spark, key):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        p = plan_of(E.queries()[key](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [ln.split("PartitionFilters: [", 1)[1].split("], PushedFilters")[0] for ln in p.splitlines() if "PartitionFilters: [" in ln and "margin" in ln.split("Batched")[0]]
    assert filters and any("dynamicpruning" in f if key == "history_window" else "week#" in f for f in filters)
    assert "lineitem" not in p


def test_refresh_rewrites_only_its_weeks(spark, tables, tmp_path):
    path = str(tmp_path / "history")
    HS.write_weeks(HS.history_rows(tables), path)

    def files():
        return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    before, rows = files(), sorted(map(str, HS.read_store(spark, path).collect()))
    HS.refresh(tables, path, 100, 101)
    after = files()
    changed = {f.split("week=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert changed == {"100", "101"} and all(after[f] == t for f, t in before.items() if f in after)
    assert sorted(map(str, HS.read_store(spark, path).collect())) == rows


def test_files_of_several_versions_read_as_the_present_schema(spark, tmp_path):
    path = str(tmp_path)
    spark.sql("SELECT 1 AS id, CAST(1.5 AS DECIMAL(5, 2)) AS price").write.parquet(f"{path}/v1")
    spark.sql("SELECT CAST(2 AS BIGINT) AS id, CAST(2.25 AS DECIMAL(10, 2)) AS price, CAST(3 AS DOUBLE) AS area").write.parquet(f"{path}/v2")
    spark.sql("SELECT 'x' AS extra, CAST(4 AS BIGINT) AS id").write.parquet(f"{path}/v3")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DecimalType(12, 2)), T.StructField("area", T.DoubleType())])
    got = sorted((r["id"], None if r["price"] is None else float(r["price"]), r["area"]) for r in S.read_versions(spark, path, schema).collect())
    assert got == [(1, 1.5, None), (2, 2.25, 3.0), (4, None, None)]
    narrow = T.StructType([T.StructField("id", T.IntegerType())])
    with pytest.raises(ValueError, match="narrowing"):
        S.read_versions(spark, path, narrow)
    os.makedirs(f"{path}/none")
    assert S.read_versions(spark, f"{path}/none", schema).count() == 0


@pytest.mark.parametrize("ascending", [False, True])
def test_export_in_several_files_keeps_the_order(spark, tmp_path, ascending):
    rows = [(f"s{i:03d}", None if i % 9 == 0 else float(i * 37 % 101), False) for i in range(300)] + [("TOTAL", 1e9, True)]
    m = spark.createDataFrame(rows, "site string, margin double, is_total boolean").repartition(5)
    path = str(tmp_path / "out")
    S.write_matrix(m, path, ascending=ascending, files=6)
    names = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    got = []
    for f in names:
        with open(os.path.join(path, f), encoding="utf-8") as lines:
            got += [ln.split(",")[0] for ln in lines.read().splitlines()[1:]]
    sign = 1 if ascending else -1
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[1] is None, sign * (r[1] or 0), r[0]))]
    assert len(names) > 2 and got == want and got[-1] == "TOTAL"


def test_sketches_of_groups_merge_to_that_of_all(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("week"), F.concat(F.lit("s"), (F.col("id") % 20_000).cast("string")).alias("site"))
    got = {r["group"]: r for r in AD.distinct_by_sketch(rows, "week", "site").collect()}
    assert set(got) == {None, *range(7)} and got[None]["exact"] == 20_000
    assert all(r["within_bound"] and r["merged_equal"] for r in got.values())


def test_collation_folds_every_script(spark):
    rows = [("PRODUCCIÓN PROMEDIO", "produccion_prom"), ("Producción  promedio".replace("  ", " "), "produccion_prom"), ("mdat", "mdat"), (" Mdat ", "mdat"), ("vacas en ORDEÑA", "vacas_ordena"),
            ("Días de lactancia promedio", "dias_lactancia"), ("MDΑT", None), ("mdat x", None), (None, None), ("", None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "i int, concept string")
    assert {r["i"]: r["concept_key"] for r in attach_by_collation(df).collect()} == {i: k for i, (_, k) in enumerate(rows)}
    same = spark.sql("SELECT 'Ἀθῆναι' COLLATE UNICODE_CI_AI = 'αθηναι' AS a, 'Ёлка' COLLATE UNICODE_CI_AI = 'елка' AS b").first()
    assert same["a"] and same["b"]
    rows_join = [ln for ln in plan_of(attach_by_collation(df)).split("== Initial Plan ==")[0].splitlines() if "Join" in ln and "LeftOuter" in ln]
    assert rows_join and "collate" not in rows_join[0]  # the rows meet their spelling by plain equality


def test_sql_functions_for_sites_and_concepts(spark):
    register_sql_functions(spark)
    got = spark.sql("SELECT wc_site_name(' Soc. Agricola  Los Robles ') AS a, wc_site_name('fundo Sol') AS b, wc_concept_key('VACAS EN ORDENA') AS c, "
                    "wc_concept_key('relación vaca ordeña / vaca masa ') AS d, wc_concept_key('otro') AS e, wc_site_name('Agr. Ag. Norte') AS f").first()
    assert tuple(got) == ("Los Robles", "Sol", "vacas_ordena", "relacion_ordena_masa", None, "Norte")


def test_history_report_from_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Fecha,N° Semana,Empresa,I) MDAT\n2025-01-07,2,Ag. Los Maitenes,"1.234,5"\n14-01-2025,10,Fundo Sol,7\nx,y,Alfa,n/d\n', encoding="utf-8")
    rows = H.read_history_report(spark, str(tmp_path)).collect()
    assert [(r["day"], r["week"], r["site"], r["margin"]) for r in rows] == [
        (dt.date(2025, 1, 14), 10, "Sol", 7.0), (dt.date(2025, 1, 7), 2, "Los Maitenes", 1234.5), (None, None, "Alfa", None)]
    with pytest.raises(KeyError):
        H.clean_history_report(spark.createDataFrame([("a",)], "Empresa string"))


def test_history_and_margin_validators(spark):
    ok = spark.createDataFrame([("1", "A", "2")], "`N° Semana` string, Empresa string, `(I) MDAT` string")
    assert H.validate_history(ok) == H.validate_margins(ok) == []
    assert H.validate_history(ok.drop("N° Semana")) == ["no column for semana"]
    assert H.validate_margins(ok.drop("(I) MDAT").limit(0)) == ["missing column: (I) MDAT", "empty report"]


def test_margin_rows_go_to_the_first_site_of_their_company(spark):
    companies = spark.createDataFrame([(1, "Soc. Agricola Uno"), (2, "Fundo Dos"), (3, "uno")], "company_id int, name string")
    sites = spark.createDataFrame([(9, "z", 1), (4, "y", 2), (7, "x", 3)], "site_id long, name string, company_id int")
    first = ML.first_sites(sites, companies)
    assert sorted(map(tuple, first.collect())) == [("dos", 4, 2, "y"), ("uno", 7, 3, "x")]  # of both companies named uno the lowest site
    report = spark.createDataFrame([
        (1, "UNO", "5", "2024", "10.5", "3"), (2, "Agr. Uno", "5", "2024", "11", None), (3, "Dos", "6", None, "1", "1"), (4, "Tres", "6", "2024", "1", "1"),
        (5, "Dos", "seis", "2024", "1", "1"), (6, "Dos", "99999999999", "2024", "1", "1"), (7, "Dos", "7", "2024", "1e30", "1"), (8, "Dos", "7", "2024", None, "1"),
        (9, None, "7", "2024", "1", "1")], "row_no long, Empresa string, `N° Semana` string, `Año` string, `(I) MDAT` string, `Vacas en ordeña` string")
    stored = spark.createDataFrame([(7, 5, 2024, 3, 1.0, 1), (7, 6, 2024, 3, 2.0, 2)], "site_id long, week int, year int, company_id int, margin double, weight long")
    load = ML.load_margins(report, first, stored, 2025)
    assert sorted((r["site_id"], r["week"], r["year"], r["margin"], r["weight"]) for r in load.table.collect()) == [(4, 6, 2025, 1.0, 1), (7, 5, 2024, 11.0, None), (7, 6, 2024, 2.0, 2)]
    assert {r["row_no"]: r["reason"] for r in load.rejects.collect()} == {4: ML.REASON_UNKNOWN, 5: ML.REASON_ERROR, 6: ML.REASON_ERROR, 7: ML.REASON_ERROR, 8: ML.REASON_EMPTY, 9: ML.REASON_UNKNOWN}
    assert tuple(load.stats.first()) == (9, 3, 6, 2)


def test_preview_has_its_history_and_the_daily_level(spark):
    rows = [r.asDict() for r in E.queries()["report_matrix"](spark, "/root/testdata/sf0.01").filter("NOT is_total").collect()]
    for c in ("weight_4w", "weight_52w", "margin_4w", "margin_52w", "rank_4w", "rank_52w"):
        assert any(r[c] is not None for r in rows), c


def test_dimension_sites_by_company_code(spark):
    dim = spark.createDataFrame([(1, "a", 5)], "company_id int, name string, site_id long")
    companies = spark.createDataFrame([(1, "C1"), (2, "C2")], "company_id int, code string")
    incoming = spark.createDataFrame([("C1", "a"), ("C2", "a"), ("C2", "a"), ("C9", "b")], "code string, name string")
    assert sorted(map(tuple, MG.load_sites(dim, incoming, companies).collect())) == [(1, "a", 5), (2, "a", 6)]


def test_expired_and_idle_sessions_go(spark):
    t = dt.datetime(2024, 1, 31)
    day = dt.timedelta(days=1)
    rows = [(1, t, True, t - 20 * day), (2, t - day, True, t), (3, t + day, False, t - 8 * day), (4, t + day, False, t - 7 * day), (5, None, None, t)]
    s = spark.createDataFrame(rows, "id int, expires_at timestamp_ntz, active boolean, session_end timestamp_ntz")
    assert sorted(r["id"] for r in AD.live_sessions(s, "2024-01-31 00:00:00").collect()) == [1, 4, 5]


def test_bindings_reach_one_calendar(spark, tables):
    assert B.latest_run_week(tables) > 300
