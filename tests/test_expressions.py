"""Table-driven cases for the scalar expressions (FIXTURES §6 and SURVEY §8 traps)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekcraft.functions import clean as C
from weekcraft.functions.concepts import CONCEPT_SPELLINGS, attach_concept_key


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("869.43", 869.43), ("869,43", 869.43), ("1.234,56", 1234.56), ("$ 1.234,56", 1234.56), ("12 %", 12.0),
    ("200022", 200022.0), ("", None), ("   ", None), (None, None), ("abc", None), ("1,234,567", None),
    ("1.234", 1.234), ("nan", None), ("1d", None), ("1_0", None), (" 7 ", 7.0),
])
def test_clean_number(spark, text, expected):
    assert one(spark, C.clean_number, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("(A) Vacas en ordeña", "Vacas en ordeña"), ("(1) Producción  total", "Producción total"), ("(BB) ", None),
    ("", None), ("  Precio   de la leche ", "Precio de la leche"),
])
def test_clean_concept(spark, text, expected):
    assert one(spark, C.clean_concept, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Agricola El Sol", "El Sol"), ("Soc. Agricola El Sol", "El Sol"), ("Fundo Soc. X", "X"),
    ("Soc. Fundo X", "Fundo X"), ("Fundo", "Fundo"), ("  AGRICOLA  Y ", "Y"), ("Ag. Los Maitenes", "Los Maitenes"),
])
def test_clean_site_name(spark, text, expected):
    assert one(spark, C.clean_site_name, text) == expected


def test_site_name_matches_sequential_rule(spark):
    """The single-regex cleaner equals testing each prefix once, in order."""
    def py(name):
        clean = name.strip()
        for p in C.SITE_PREFIXES:
            if clean.lower().startswith(p.lower() + " "):
                clean = clean[len(p):].strip()
        return clean
    words = ["Soc.", "Agricola", "Agr.", "Ag.", "Fundo", "Soc. Agr.", "Soc. Agricola", "X", "Los"]
    import itertools
    names = [" ".join(c) for n in range(1, 4) for c in itertools.product(words, repeat=n)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.c for r in df.select("n", C.clean_site_name("n").alias("c")).collect()}
    assert {n: py(n) for n in names} == got


@pytest.mark.parametrize("text,key", [
    ("PRODUCCION PROMEDIO", "produccion_prom"), ("vacas en ordeña", "vacas_ordena"), ("Carga animal", None),
    ("Relación vaca ordeña / vaca masa ", "relacion_ordena_masa"), ("MDAT", "mdat"),
])
def test_concept_key(spark, text, key):
    df = spark.createDataFrame([(text,)], "concept string")
    assert attach_concept_key(df).first()["concept_key"] == key


def test_dictionary_has_30_spellings_and_23_keys():
    assert len(CONCEPT_SPELLINGS) == 30
    assert len({k for _, k in CONCEPT_SPELLINGS}) == 23


@pytest.mark.parametrize("value,expected", [(1234567.891, "1.234.567,89"), (-0.5, "-0,50"), (None, ""),
                                            (2.675, "2,67"), (0.125, "0,12")])
def test_fmt_es(spark, value, expected):
    assert one(spark, C.fmt_es, value, "double") == expected


def test_money_pct_int(spark):
    assert one(spark, C.fmt_money, 1234.5, "double") == "$1.234,50"
    assert one(spark, C.fmt_pct, 3.5, "double") == "3,50%"
    assert one(spark, C.fmt_int, -7.9, "double") == "-7"
    assert one(spark, C.fmt_money, None, "double") == ""


@pytest.mark.parametrize("text,expected", [("27-09-2025", dt.date(2025, 9, 27)), ("7-9-2025", dt.date(2025, 9, 7)),
                                           ("31-02-2025", None), ("x", None)])
def test_parse_day(spark, text, expected):
    assert one(spark, C.parse_day, text) == expected


def test_iso_week_year_quirk(spark):
    d = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    r = d.select(C.iso_week("d").alias("w"), C.iso_year("d").alias("y"), F.year("d").alias("cy")).first()
    assert (r.w, r.y, r.cy) == (1, 2025, 2024)


def test_safe_int_truncates(spark):
    assert one(spark, C.safe_int, "12.9") == 12
    assert one(spark, C.safe_int, "-12.9") == -12
    assert one(spark, C.safe_int, "x") is None


def test_fold_and_ci(spark):
    assert one(spark, C.fold_text, "Ordeña? Producción") == "Ordena Produccion"
    assert one(spark, lambda c: C.contains_ci(c, "ORDE"), "vacas en ordeña") is True
    assert one(spark, C.company_code, " 96.719.960-5 _x") == "96.719.960-5"


def test_week_fallback_and_key(spark):
    assert one(spark, C.week_fallback_date, 3, "int") == dt.date(2025, 1, 15)
    assert one(spark, lambda c: C.week_key(F.lit(2025), c), 7, "int") == 202507


def test_map_and_json(spark):
    assert one(spark, lambda c: C.map_value(c, {"exito": "ok"}, "?"), "exito") == "ok"
    assert one(spark, lambda c: C.map_value(c, {"exito": "ok"}, "?"), "other") == "?"
    default = F.struct(F.lit(0.0).alias("min_area"))
    assert one(spark, lambda c: C.json_or_default(c, "min_area double", default), '{"min_area": 3}')["min_area"] == 3.0
    assert one(spark, lambda c: C.json_or_default(c, "min_area double", default), None)["min_area"] == 0.0
