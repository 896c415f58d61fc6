"""Rows that must not get lost, and rules checked on inputs that the bindings do not make."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from weekcraft import session
from weekcraft.functions import clean as C
from weekcraft.operators.merge import assign_ids, upsert, write_table
from weekcraft.operators.windows import trailing_fixed
from weekcraft.plans import report as R
from weekcraft.sources import reports as S
from weekcraft.streaming import arrival


def test_upsert_with_a_null_partition_keeps_all_rows(spark):
    target = spark.createDataFrame([(10, 1, "a"), (20, 2, "b"), (30, 3, "c"), (None, 4, "d")], "p int, k int, v string")
    batch = spark.createDataFrame([(20, 2, "B"), (None, 5, "e")], "p int, k int, v string")
    got = {(r.p, r.k, r.v) for r in upsert(target, batch, ["k"], {"p": "new", "v": "new"}, partition_col="p").collect()}
    assert got == {(10, 1, "a"), (20, 2, "B"), (30, 3, "c"), (None, 4, "d"), (None, 5, "e")}


def test_emptied_partition_is_removed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "k int, p int").write.partitionBy("p").parquet(path)
    stored = spark.read.parquet(path)
    left = session.materialize(stored.where("p <> 10 AND k <> 3"), "left")
    touched = session.materialize(stored.select("p").distinct(), "touched")
    write_table(left, path, ["p"], emptied=touched)
    assert [tuple(r) for r in spark.read.parquet(path).select("k", "p").collect()] == [(2, 20)]


BATCH = "site_id long, day date, concept string, company_id int, category string, value double, row_no long"


def test_failing_read_does_not_wipe_stored_days(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/daily"
    day = date(2024, 1, 1)
    arrival.apply_batch(spark, spark.createDataFrame([(1, day, "x", 1, "c", 1.0, 1)], BATCH), path)
    second = spark.createDataFrame([(2, day, "x", 1, "c", 2.0, 2)], BATCH)
    with monkeypatch.context() as m:
        m.setattr(arrival, "path_exists", lambda *_: (_ for _ in ()).throw(OSError("listing failed")))
        with pytest.raises(OSError):
            arrival.apply_batch(spark, second, path)
    assert spark.read.parquet(path).count() == 1
    arrival.apply_batch(spark, second, path)
    assert sorted(r.site_id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_same_day_rows_are_not_before_each_other(spark):
    rows = [("s", 1, date(2025, 1, 1), 10.0), ("s", 2, date(2025, 1, 8), 20.0), ("s", 3, date(2025, 1, 8), 30.0), ("s", 4, date(2025, 1, 9), None)]
    h = spark.createDataFrame(rows, "site string, week int, day date, margin double").withColumn("weight", F.lit(1.0))
    got = {r.week: r.margin_4f for r in trailing_fixed(h).collect()}
    assert got == {1: None, 2: 2.5, 3: 2.5, 4: 15.0}


CELLS = ("company string, company_code_raw string, site_raw string, category string, concept_raw string, year int, week int, day_text string, "
         "cell_text string, total_text string, row_no long, report_row string")


def _cells(spark, rows):
    made = [("Co", "1_Co", "Fundo Uno", "c", concept, 2025, 40, "1-10-2025", cell, total, i, str(i)) for i, (concept, cell, total) in enumerate(rows)]
    return R.parse_cells(spark.createDataFrame(made, CELLS)).withColumn("reason", R.reject_reason())


def test_margin_loads_and_is_not_unmapped(spark):
    tagged = _cells(spark, [("(I) MDAT", "8950", "8950"), ("(Z) Otra cosa", "1", "1")])
    assert R.weekly_from_report(tagged).first()["margin"] == 8950.0
    assert [r.concept for r in R.unmapped_concepts(tagged).collect()] == ["otra cosa"]


def test_rows_of_one_concept_are_averaged(spark):
    tagged = _cells(spark, [("(A) Vacas en ordeña", "10", "10"), ("(A) Vacas en ordeña", "20", "20")])
    assert R.weekly_from_report(tagged).first()["weight"] == 15.0


def test_means_are_not_rounded_before_dividing(spark):
    from weekcraft.operators.aggregates import dec_avg
    df = spark.createDataFrame([(0.125,), (0.25,)], "x double")
    assert df.agg(dec_avg("x").alias("m")).first()["m"] == 0.1875


def test_folder_of_reports_with_other_days(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Empresa,Establecimiento,Categoria,Concepto,A. Total,29-9-2025,30-9-2025\nCo,Uno,c,Vacas,3,1,2\n")
    (tmp_path / "b.csv").write_text("Empresa,Establecimiento,Categoria,Concepto,A. Total,6-10-2025\nCo,Uno,c,Vacas,5,5\n")
    got = sorted((r.day_text, r.cell_text) for r in S.read_reports(spark, f"file://{tmp_path}").collect())
    assert got == [("29-9-2025", "1"), ("30-9-2025", "2"), ("6-10-2025", "5")]


def test_integers_beyond_32_bits(spark):
    got = spark.createDataFrame([("3000000000",), ("-2.9",), ("1e30",)], "x string").select(C.safe_int("x").alias("i")).collect()
    assert [r.i for r in got] == [3_000_000_000, -2, None]


def test_accents_of_other_languages_and_forms(spark):
    got = spark.createDataFrame([("ñandú ő Ž ṽ ñ?",)], "x string").select(C.fold_text("x").alias("y")).first()["y"]
    assert got == "nandu o Z v n"


def test_ids_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "k string").repartition(7)
    got = {r.k: r.id for r in assign_ids(df, ["k"], 11, "id").collect()}
    assert got == {f"k{i:03d}": 11 + i for i in range(300)}


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_stage_names_are_unique(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
