"""History report load (SRC-2, SCH-5, SCH-6, QLT-3, QLT-7, QLT-8, AGG-10, NUM-1, NUM-2, MRG-3).

Headers are matched on the driver (O(columns)); every row-level step is one set-based
job: header coalescing, row rejects, the modal date of each week (a two-level
aggregate joined back by week), date imputation, last write per (week, site) and the
keyed rewrite into the history table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.functions import clean as C
from weekcraft.operators.merge import upsert
from weekcraft.session import materialize
from weekcraft.sources.tables import Tables

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: header substring pattern -> history column,
# in the reference's order. Build rule (see SURVEY Q11/Q12): patterns are normalised like
# headers and the longest contained pattern wins.
# ---------------------------------------------------------------------------
HISTORY_HEADER_PATTERNS = [
    ("semana", "semana"), ("n° semana", "semana"), ("nâ° semana", "semana"), ("fecha", "fecha"),
    ("establecimiento", "establecimiento"), ("empresa", "establecimiento"),
    ("vacas en ordeña", "vacas_en_ordena"), ("vacas en ordena", "vacas_en_ordena"), ("vacas en ord", "vacas_en_ordena"),
    ("(a) vacas", "vacas_en_ordena"), ("vacas masa", "vacas_masa"),
    ("vacas en producción", "vacas_en_produccion"), ("vacas en produccion", "vacas_en_produccion"),
    ("vacas en producci", "vacas_en_produccion"),
    ("le envían", "leche_enviada"), ("le envian", "leche_enviada"), ("leche enviada", "leche_enviada"),
    ("che no", "leche_no_vendible"), ("pna terr", "pna_terneros"), ("pna tern", "pna_terneros"),
    ("producción", "produccion_total"), ("produccion", "produccion_total"), ("precio de", "precio_leche"),
    ("dias lactancia", "dias_lactancia"), ("días lactancia", "dias_lactancia"), ("lactancia", "dias_lactancia"),
    ("% grasa", "porcentaje_grasa"), ("grasa", "porcentaje_grasa"), ("% prot", "porcentaje_proteina"),
    ("proteina", "porcentaje_proteina"), ("proteínas", "porcentaje_proteina"),
    ("kg ms prad", "kg_ms_pradera"), ("ms pradera", "kg_ms_pradera"), ("kg ms cons", "kg_ms_conservado"),
    ("ms conserv", "kg_ms_conservado"), ("kg ms conc", "kg_ms_concentrado"), ("ms concent", "kg_ms_concentrado"),
    ("consumo ms", "consumo_ms"), ("ms var", "consumo_ms"), ("ms por ha", "ms_por_ha"), ("ms/ha", "ms_por_ha"),
    ("taje leche", "costo_racion_vaca"), ("costo raci", "costo_racion_vaca"),
    ("mdat", "mdat"), ("(i) mdat", "mdat"),
    ("eficie", "eficiencia"), ("eficiencia", "eficiencia"),
    ("centaje c", "relacion_ordena_masa"),
    ("superficie", "superficie_praderas"),
    ("% leche no", "porcentaje_leche_no_vendible"),
]
# Stocking has no pattern in the reference although it is read (Q10); this build adds one.
EXTRA_HEADER_PATTERNS = [("carga animal", "carga_animal")]
# Type of every measure of the history, in the reference's order; margin and weight are this build's names of two.
HISTORY_MEASURES = {
    "vacas_en_produccion": "long", "leche_enviada": "double", "leche_no_vendible": "double", "pna_terneros": "double",
    "produccion_total": "double", "precio_leche": "double", "dias_lactancia": "long", "porcentaje_grasa": "double",
    "porcentaje_proteina": "double", "kg_ms_pradera": "double", "kg_ms_conservado": "double", "kg_ms_concentrado": "double",
    "consumo_ms": "double", "ms_por_ha": "double", "costo_racion_vaca": "double", "mdat": "double", "eficiencia": "double",
    "vacas_masa": "long", "vacas_en_ordena": "long", "relacion_ordena_masa": "double", "superficie_praderas": "double",
    "porcentaje_leche_no_vendible": "double", "carga_animal": "double",
}
MEASURE_NAMES = {"mdat": "margin", "vacas_en_ordena": "weight"}
# Margin column candidates of the margin-history report, first present wins (SCH-6).
MARGIN_CANDIDATES = ["MDAT", "(I) MDAT", "I) MDAT", "MDAT (I)", "I MDAT"]
# Fixed reject reasons (QLT-3).
REASON_NO_WEEK, REASON_NO_SITE = "Semana vacía", "Establecimiento vacío"
# Reasons of this build, for numbers that cannot be stored.
REASON_WEEK_RANGE, REASON_VALUE_RANGE = "Semana fuera de rango", "Valor fuera de rango"


# Letters that encodings garble in the reports' headers, and degree signs, for fuzzy matching (SCH-5).
_HEADER_FOLD = str.maketrans("âãñ", "aan", "°º")


def normalize_header(h: str) -> str:
    """A header for fuzzy matching: lower case, without outer blanks, by ``_HEADER_FOLD``."""
    return str(h).strip().lower().translate(_HEADER_FOLD)


def map_headers(columns: list[str]) -> dict[str, str]:
    """SCH-5: header -> target column; the longest normalised pattern contained wins."""
    pats = [(normalize_header(p), t) for p, t in HISTORY_HEADER_PATTERNS + EXTRA_HEADER_PATTERNS]
    pats = sorted(pats, key=lambda pt: -len(pt[0]))
    out = {}
    for col in columns:
        h = normalize_header(col)
        for p, t in pats:
            if p in h:
                out[col] = t
                break
    return out


def first_present(columns: list[str], candidates: list[str] = MARGIN_CANDIDATES) -> str:
    """SCH-6: the first candidate column present, else an error."""
    for c in candidates:
        if c in columns:
            return c
    raise KeyError(f"none of {candidates} in the report")


# Binding of the report generator: header as a person types it, measure, factor and range of its value in hundredths.
REPORT_MEASURES = [
    ("Vacas en Producción", "vacas_en_produccion", 7, 40_000), ("Leche que le envían", "leche_enviada", 11, 900_000),
    ("Leche no vendible", "leche_no_vendible", 13, 30_000), ("PNA Terneros", "pna_terneros", 17, 20_000),
    ("Producción total", "produccion_total", 19, 950_000), ("Precio de la leche", "precio_leche", 23, 60_000),
    ("Días lactancia", "dias_lactancia", 29, 40_000), ("% Grasa", "porcentaje_grasa", 31, 700), ("% Proteína", "porcentaje_proteina", 37, 600),
    ("Kg MS pradera", "kg_ms_pradera", 41, 2_000), ("Kg MS conservado", "kg_ms_conservado", 43, 1_500), ("Kg MS concentrado", "kg_ms_concentrado", 47, 1_200),
    ("Consumo MS", "consumo_ms", 53, 2_500), ("MS por ha", "ms_por_ha", 59, 9_000), ("Costo ración", "costo_racion_vaca", 61, 80_000),
    ("Eficiencia", "eficiencia", 67, 300), ("Vacas masa", "vacas_masa", 71, 50_000), ("Porcentaje corregido", "relacion_ordena_masa", 73, 10_000),
    ("Superficie praderas", "superficie_praderas", 79, 30_000), ("% leche no vendible", "porcentaje_leche_no_vendible", 83, 5_000),
    ("Carga animal", "carga_animal", 89, 400),
]


def history_report(t: Tables) -> DataFrame:
    """History report binding: one text row per order with every measure, headers as a person would type them.

    Weeks, sites and dates are blank or broken for some rows, and each measure for every 17th (by key arithmetic)."""
    o = t.orders
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row_no"),
        F.when(k % 62 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("Co "), (F.col("o_custkey") % 7).cast("string"))).alias("Empresa"),
        F.when(k % 37 == 0, F.lit("x")).otherwise(F.weekofyear("o_orderdate").cast("string")).alias("N° Semana"),
        F.when(k % 31 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Site "), (F.col("o_custkey") % 40).cast("string"))).alias("Establecimiento"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "d-M-yyyy")).alias("Fecha"),
        F.regexp_replace(F.format_number(F.col("o_totalprice") / 100, 2), ",", "").alias("(I) MDAT"),
        F.format_number(F.col("o_custkey") % 300 + 0.75, 2).alias("(A) Vacas en ordeña"),
        *[F.when((k + factor) % 17 != 0, F.concat_ws(".", F.floor((k * factor) % most / 100).cast("string"), F.lpad(((k * factor) % 100).cast("string"), 2, "0"))).alias(header)
          for header, _, factor, most in REPORT_MEASURES])


def mapped_records(report: DataFrame, order_col: str = "row_no") -> DataFrame:
    """Coalesce every target from its headers: the last non-null in column order wins."""
    mapping = map_headers([c for c in report.columns if c != order_col])
    by_target: dict[str, list[str]] = {}
    for col in report.columns:
        if col in mapping:
            by_target.setdefault(mapping[col], []).append(col)

    def cell(c):
        return F.nullif(C.strip_ws(F.col(f"`{c}`")), F.lit(""))
    cols = [F.coalesce(*[cell(c) for c in reversed(cs)]).alias(tgt) for tgt, cs in by_target.items()]
    return report.select(F.col(order_col), *cols)


def modal_day(rec: DataFrame) -> DataFrame:
    """AGG-10: per week the most frequent day; ties go to the day seen first."""
    d = (rec.filter(F.col("week").isNotNull() & F.col("day").isNotNull())
            .groupBy("week", "day").agg(F.count(F.lit(1)).alias("_n"), F.min("row_no").alias("_first")))
    return d.groupBy("week").agg(F.max_by("day", F.struct(F.col("_n"), -F.col("_first"))).alias("modal_day"))


def parse_history(report: DataFrame) -> DataFrame:
    """(row_no, week, site, day, every measure); a measure without a header is null. Written once: the steps that
    follow read the parsed values several times, and 23 parsed columns make a plan of their own."""
    rec = mapped_records(report)
    cols = set(rec.columns)

    def opt(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")
    parsed = rec.select(
        "row_no",
        C.safe_int(opt("semana")).alias("week"),
        C.strip_ws(opt("establecimiento")).alias("site"),
        C.parse_day(opt("fecha")).alias("day"),
        *[(C.safe_int if kind == "long" else C.safe_float)(opt(m)).alias(MEASURE_NAMES.get(m, m))
          for m, kind in HISTORY_MEASURES.items()])
    return materialize(parsed, "history-rows")


def reject_reason():
    """QLT-3: the joined reasons of a parsed row, '' for a valid one: no week or site, a week or measure out of range."""
    large = [~C.in_range(MEASURE_NAMES.get(m, m)) for m in HISTORY_MEASURES]
    return F.concat_ws(" | ", F.when(F.col("week").isNull(), F.lit(REASON_NO_WEEK)),
                       F.when(~F.col("week").between(*C.WEEK_RANGE), F.lit(REASON_WEEK_RANGE)),
                       F.when(F.col("site").isNull(), F.lit(REASON_NO_SITE)),
                       F.when(F.coalesce(*[F.when(x, True) for x in large]), F.lit(REASON_VALUE_RANGE)))


def history_rejects(parsed: DataFrame) -> DataFrame:
    """QLT-3: the rows that are not loaded, with the joined reasons."""
    return parsed.select("row_no", reject_reason().alias("reason")).filter("reason <> ''")


def load_history(report: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """QLT-8 ``process_historico``: map, reject, impute the date (own date, else the week's
    modal date, else the week-derived date; QLT-7), keep the last row per (week, site) and
    upsert into ``target`` replacing every measure (MRG-3). A measure that ``target`` lacks is null in its rows."""
    parsed = parse_history(report)
    modal = modal_day(parsed)
    ok = parsed.filter(reject_reason() == "")
    filled = (ok.join(modal, "week", "left")
                .withColumn("day", F.coalesce(F.col("day"), F.col("modal_day"), C.week_fallback_date(F.col("week"))))
                .drop("modal_day"))
    measures = [MEASURE_NAMES.get(m, m) for m in HISTORY_MEASURES]
    batch = filled.select("week", "site", "day", *measures, "row_no")
    if target is None:
        target = batch.drop("row_no").limit(0)
    target = target.select("*", *[F.lit(None).cast(batch.schema[m].dataType).alias(m) for m in measures if m not in target.columns])
    return upsert(target, batch, ["week", "site"], dict.fromkeys(["day", *measures], "new"), order_col="row_no")


def clean_history_report(report: DataFrame) -> DataFrame:
    """SRC-2: the persistent history report as (day, week, site, margin) beside its columns, latest week first.

    The margin comes from the first candidate column present (SCH-6); a report without a site column names sites as companies;
    sites get the literal replacement (STR-8) and lose their prefixes (STR-3). Unreadable dates, weeks and numbers are null.
    """
    margin = first_present(report.columns)
    site = "Establecimiento" if "Establecimiento" in report.columns else "Empresa"
    named = {"site": C.clean_site_name(C.replace_literals(site, C.SITE_LITERAL_REPLACEMENTS)), "margin": C.clean_number(f"`{margin}`"),
             "day": F.coalesce(F.try_to_date(C.strip_ws("Fecha"), "yyyy-MM-dd"), C.parse_day("Fecha")) if "Fecha" in report.columns else F.lit(None).cast("date"),
             "week": C.safe_int("`N° Semana`") if "N° Semana" in report.columns else F.lit(None).cast("long")}
    return report.withColumns(named).orderBy(F.col("week").desc_nulls_last())


def read_history_report(spark, path: str) -> DataFrame:
    """SRC-2 from files: all columns as text, then ``clean_history_report``."""
    return clean_history_report(spark.read.option("header", True).option("inferSchema", False).csv(path))


def validate_history(report: DataFrame) -> list[str]:
    """SCH-3 / QLT-1 of the history load: week and site need a header that maps to them, and there must be rows."""
    mapped = set(map_headers(report.columns).values())
    errors = [f"no column for {c}" for c in ("semana", "establecimiento") if c not in mapped]
    return errors + (["empty report"] if report.isEmpty() else [])


def validate_margins(report: DataFrame) -> list[str]:
    """SCH-3 / QLT-1 of the margin load: its three columns as they are written, and rows."""
    errors = [f"missing column: {c}" for c in ("Empresa", "N° Semana", "(I) MDAT") if c not in report.columns]
    return errors + (["empty report"] if report.isEmpty() else [])


def history_for_matrix(hist: DataFrame, as_of, weeks_back: int = 52, company: str | None = None,
                       company_col: str = "company") -> DataFrame:
    """SRC-9: history rows from ``weeks_back`` weeks before ``as_of`` (a parameter, not the
    current date, so results are reproducible), optionally one company compared
    case-insensitively (STR-10); newest first."""
    out = hist.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), 7 * weeks_back))
    if company is not None:
        out = out.filter(C.equals_ci(F.col(company_col), F.lit(company)))
    return out.orderBy(F.col("day").desc(), F.col(company_col))
