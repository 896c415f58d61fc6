"""Wide CSV report reader (SRC-1, SCH-1..4) feeding the ingest jobs; sinks."""

import os
from datetime import date
import tempfile

from weekcraft.plans import report as R
from weekcraft.sources import reports as S

CSV = """Empresa,Empresa_COD,Establecimiento,CATEGORIA,CONCEPTO,27-09-2025,28-09-2025,A. TOTAL,N Semana
Eduvigis,96.719.960-5_x,Fundo Los Robles,Inventario,(A) Vacas en ordeña,420,"421,5","420,75",39
Eduvigis,96.719.960-5_x,Fundo Los Robles,Produccion,(B) Producción promedio,"32,5",abc,,39
Eduvigis,96.719.960-5_x,Fundo Los Robles,Produccion,(C) Precio de la leche,385,"1.385,00",,39
Otra,77_y,Agricola El Sol,Inventario,(BB) ,1,2,3,39
"""


def _write(text):
    d = tempfile.mkdtemp(prefix="weekcraft-csv-")
    with open(os.path.join(d, "r.csv"), "w", encoding="utf-8") as f:
        f.write(text)
    return d


def test_normalize_and_validate(spark):
    assert S.normalize_col("  A. TOTAL ") == "a_total"
    assert S.normalize_col("N° Semana") == "n°_semana"
    rep = S.read_week_report(spark, _write(CSV))
    assert "semana" in rep.columns and "a_total" in rep.columns
    assert S.date_columns(rep.columns) == ["27-09-2025", "28-09-2025"]
    assert S.validate(rep, S.REQUIRED_LOAD) == []
    bad = rep.drop("categoria")
    assert S.validate(bad, S.REQUIRED_LOAD) == ["missing column: categoria"]


def test_report_to_weekly(spark):
    rep = S.read_week_report(spark, _write(CSV))
    tagged = R.parse_cells(S.to_cells(rep)).withColumn("reason", R.reject_reason())
    rej = {(r.concept_raw, r.cell_text, r.reason) for r in R.load_rejects(tagged).collect()}
    assert ("(B) Producción promedio", "abc", "unparseable value") in rej
    assert ("(BB) ", "1", "empty concept") in rej
    w = {(r.site, r.week): r for r in R.weekly_from_report(tagged).collect()}
    row = w[("Los Robles", 39)]
    assert row.weight == 420.75          # row total wins
    assert row.prod == 32.5              # no total: mean of parseable day cells
    assert row.price == round((385 + 1385) / 2, 2)
    assert row.company == "Eduvigis"
    melted = R.melt_report(tagged).collect()
    assert {str(r.day) for r in melted} == {"2025-09-27", "2025-09-28"}


def test_sinks(spark, tables):
    from weekcraft.plans import matrix as M
    d = tempfile.mkdtemp(prefix="weekcraft-sink-")
    m = M.weekly_matrix(tables)
    S.write_matrix(m, os.path.join(d, "matrix"))
    back = spark.read.option("header", True).csv(os.path.join(d, "matrix"))
    assert back.count() == m.count()
    S.append_log(spark, os.path.join(d, "logs"), {"file": "r.csv", "status": "exito", "processed": 3})
    S.append_log(spark, os.path.join(d, "logs"), {"file": "r2.csv", "status": "error", "processed": 0})
    assert spark.read.parquet(os.path.join(d, "logs")).count() == 2


def test_typed_read_and_site_export(spark, tables):
    from pyspark.sql import types as T
    from weekcraft.plans import daily as D
    d = tempfile.mkdtemp(prefix="weekcraft-typed-")
    path = _write("a,b\n1,2.5\n2,x\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    rows = S.read_typed(spark, path, schema).collect()
    assert rows[0].a == 1 and rows[0].b == 2.5 and rows[1].b is None
    detail = D.daily_detail(tables, None, D.period_days(date(2024, 1, 1), 30), is_admin=True)
    S.write_daily_by_site(detail, os.path.join(d, "detail"))
    sites = {p for p in os.listdir(os.path.join(d, "detail")) if p.startswith("site=")}
    assert len(sites) == detail.select("site").distinct().count()


def test_history_header_mapping():
    from weekcraft.plans.history import first_present, map_headers
    m = map_headers(["N° Semana", "Fecha", "(A) Vacas en ordeña", "Vacas masa", "(I) MDAT", "Empresa",
                     "Precio de la leche", "Porcentaje costo alimentos", "Carga animal", "Otra cosa"])
    assert m["N° Semana"] == "semana" and m["(A) Vacas en ordeña"] == "vacas_en_ordena"
    assert m["Vacas masa"] == "vacas_masa" and m["(I) MDAT"] == "mdat" and m["Empresa"] == "establecimiento"
    assert m["Precio de la leche"] == "precio_leche" and m["Carga animal"] == "carga_animal"
    assert "Otra cosa" not in m
    assert first_present(["x", "(I) MDAT"]) == "(I) MDAT"
    import pytest
    with pytest.raises(KeyError):
        first_present(["x"])


def test_history_load_keeps_every_measure(spark):
    """Every mapped header reaches the table; a later report replaces all measures, with null where it lacks a header."""
    from weekcraft.plans import history as H
    headers = {"Vacas en producción": "vacas_en_produccion", "Le envían": "leche_enviada", "Che no": "leche_no_vendible", "PNA Tern": "pna_terneros",
               "Producción": "produccion_total", "Precio de": "precio_leche", "Dias lactancia": "dias_lactancia", "% grasa": "porcentaje_grasa",
               "% prot": "porcentaje_proteina", "Kg MS prad": "kg_ms_pradera", "Kg MS cons": "kg_ms_conservado", "Kg MS conc": "kg_ms_concentrado",
               "Consumo MS": "consumo_ms", "MS/ha": "ms_por_ha", "Costo raci": "costo_racion_vaca", "(I) MDAT": "margin", "Eficiencia": "eficiencia",
               "Vacas masa": "vacas_masa", "Vacas en ordeña": "weight", "Centaje c": "relacion_ordena_masa", "Superficie": "superficie_praderas",
               "% leche no": "porcentaje_leche_no_vendible", "Carga animal": "carga_animal"}
    names = ["row_no", "N° Semana", "Establecimiento", "Fecha", *headers]
    schema = ", ".join(f"`{n}` {'long' if n == 'row_no' else 'string'}" for n in names)
    table = H.load_history(spark.createDataFrame([(1, "7", "A", "3-2-2025", *[str(i + 10) for i in range(23)]),
                                                  (2, "8", "A", "10-2-2025", *[str(i + 50) for i in range(23)])], schema))
    got = {r["week"]: r.asDict() for r in table.collect()}
    assert {c: got[7][c] for c in headers.values()} == {c: i + 10 for i, c in enumerate(headers.values())}
    later = spark.createDataFrame([(1, "8", "A", "10-2-2025", "3.5")], "row_no long, `N° Semana` string, Establecimiento string, Fecha string, `% grasa` string")
    after = {r["week"]: r.asDict() for r in H.load_history(later, table).collect()}
    assert after[7] == got[7]
    assert {c: v for c, v in after[8].items() if v is not None and c in headers.values()} == {"porcentaje_grasa": 3.5}
    assert H.load_history(later, table.select("week", "site", "day", "margin", "weight")).count() == 2
