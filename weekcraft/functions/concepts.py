"""Concept dictionary (STR-5) and the weekly measure catalogue.

The dictionary is a 30-row table; it is joined with ``broadcast`` because its size is a
fixed constant, independent of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcraft.functions.clean import fold_text

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: report concept spellings -> concept key.
# ---------------------------------------------------------------------------
CONCEPT_SPELLINGS = [
    ("Vacas en ordeña", "vacas_ordena"),
    ("Vacas en ordena", "vacas_ordena"),
    ("Vacas masa", "vacas_masa"),
    ("Superficie Praderas", "superficie_praderas"),
    ("Producción promedio", "produccion_prom"),
    ("Produccion promedio", "produccion_prom"),
    ("Precio de la leche", "precio_leche"),
    ("Producción total", "produccion_total"),
    ("Produccion total", "produccion_total"),
    ("Kg MS Pradera / vaca", "ms_pradera"),
    ("Kg MS Verde / vaca", "ms_verde"),
    ("Kg MS Conservado / vaca", "ms_conservado"),
    ("Kg MS Concentrado / vaca", "ms_concentrado"),
    ("Praderas y otros verdes", "praderas_otros_verdes"),
    ("Total MS", "total_ms"),
    ("Consumo de mat. seca", "consumo_ms"),
    ("Mat. Seca por Ha", "ms_por_ha"),
    ("Costo ración vaca", "costo_racion_vaca"),
    ("Costo racion vaca", "costo_racion_vaca"),
    ("Costo promedio concentrado", "costo_concentrado"),
    ("Grms concentrado / ltr leche", "gramos_por_litro"),
    ("Porcentaje de grasa", "porc_grasa"),
    ("Proteinas", "proteinas"),
    ("MDAT", "mdat"),
    ("Días de lactancia promedio", "dias_lactancia"),
    ("Dias de lactancia promedio", "dias_lactancia"),
    ("Porcentaje leche no vendible", "porc_leche_no_vendible"),
    ("Relación vaca ordeña / vaca masa", "relacion_ordena_masa"),
    ("Relacion vaca ordena / vaca masa", "relacion_ordena_masa"),
    ("Relación vaca ordeña / vaca masa ", "relacion_ordena_masa"),
]

# Weekly fact measure (neutral column name) -> concept label used when the
# weekly fact is unpivoted to the long report form. Three labels (stocking, margin per
# litre, cost share) have no dictionary entry, so the matrix recomputes them.
WEEKLY_MEASURE_LABELS = [
    ("area", "Superficie Praderas"),
    ("herd", "Vacas masa"),
    ("weight", "Vacas en ordeña"),
    ("stocking", "Carga animal"),
    ("fat", "Porcentaje de grasa"),
    ("protein", "Proteinas"),
    ("conc_cost", "Costo promedio concentrado"),
    ("grams_per_litre", "Grms concentrado / ltr leche"),
    ("ms_conc", "Kg MS Concentrado / vaca"),
    ("ms_cons", "Kg MS Conservado / vaca"),
    ("greens", "Praderas y otros verdes"),
    ("total_ms", "Total MS"),
    ("prod", "Producción promedio"),
    ("cost", "Costo ración vaca"),
    ("price", "Precio de la leche"),
    ("margin_l", "MDAT (L/vaca/día)"),
    ("cost_pct", "Porcentaje costo alimentos"),
    ("margin", "MDAT"),
]
WEEKLY_MEASURES = [m for m, _ in WEEKLY_MEASURE_LABELS]
# The one unpivot branch of the reference that keeps null values.
NULL_KEPT_MEASURE = "greens"

# Matrix column -> concept key it is read from (the rest are derived).
MATRIX_FROM_KEY = [
    ("area", "superficie_praderas"),
    ("herd", "vacas_masa"),
    ("weight", "vacas_ordena"),
    ("fat", "porc_grasa"),
    ("protein", "proteinas"),
    ("conc_cost", "costo_concentrado"),
    ("grams_per_litre", "gramos_por_litro"),
    ("ms_conc", "ms_concentrado"),
    ("ms_cons", "ms_conservado"),
    ("greens_stored", "praderas_otros_verdes"),
    ("ms_pasture", "ms_pradera"),
    ("ms_green", "ms_verde"),
    ("prod", "produccion_prom"),
    ("cost", "costo_racion_vaca"),
    ("price", "precio_leche"),
    ("margin", "mdat"),
]
CONCEPT_KEYS = sorted({k for _, k in CONCEPT_SPELLINGS})


def concept_table(spark: SparkSession) -> DataFrame:
    """(spelling, concept_key, folded) — 30 rows."""
    df = spark.createDataFrame(CONCEPT_SPELLINGS, "spelling string, concept_key string")
    return df.withColumn("folded", fold_text(F.lower("spelling")))


def attach_concept_key(df: DataFrame, concept_col: str = "concept", out: str = "concept_key") -> DataFrame:
    """Exact spelling match first, then accent-folded lower-case match; else null (STR-5).

    Two left joins against broadcast copies of the 30-row dictionary (bounded size).
    """
    spark = df.sparkSession
    t = concept_table(spark)
    exact = F.broadcast(t.select(F.col("spelling").alias("_sp"), F.col("concept_key").alias("_k1")))
    folded = F.broadcast(t.groupBy(F.col("folded").alias("_fo")).agg(F.min("concept_key").alias("_k2")))
    return (df.withColumn("_fold", fold_text(F.lower(F.col(concept_col))))
              .join(exact, F.col(concept_col) == F.col("_sp"), "left")
              .join(folded, F.col("_fold") == F.col("_fo"), "left")
              .withColumn(out, F.coalesce("_k1", "_k2"))
              .drop("_fold", "_sp", "_k1", "_fo", "_k2"))


#: A collation under which texts are equal whatever their case and accents, composed or combining.
COLLATION = "UNICODE_CI_AI"


def attach_by_collation(df: DataFrame, concept_col: str = "concept", out: str = "concept_key") -> DataFrame:
    """STR-4, STR-5 and STR-10 without letter tables: spellings meet the 30-row dictionary under a collation.

    Covers the accents of every script. Collated keys join by sorting only, so the distinct spellings are joined, not the
    rows: a frequent concept is no hot key, and the rows look their spelling up by plain equality, in a table that AQE
    broadcasts where it is measured small.
    """
    t = concept_table(df.sparkSession).groupBy(F.collate(F.trim("spelling"), COLLATION).alias("_sp")).agg(F.min("concept_key").alias(out))
    typed = df.select(F.col(concept_col).alias("_typed")).filter(F.col("_typed").isNotNull()).distinct()
    known = typed.join(t, F.collate(F.trim("_typed"), COLLATION) == F.col("_sp")).select("_typed", out)
    return df.join(known, F.col(concept_col) == F.col("_typed"), "left").drop("_typed")
