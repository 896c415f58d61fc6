"""The margin-history load (MRG-4, JOIN-8, JOIN-12, QLT-4): rows named by company, written to the company's first site.

A row of the report names a company; names are compared without the known prefixes and in lower case. Its
margins belong to the company's first site (the lowest id). A row is rejected, with a reason, where no company has the name,
where a value cannot be read, or where the margin is empty; the later row of one site, week and year is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.functions import clean as C
from weekcraft.operators.merge import first_per_group, upsert
from weekcraft.session import materialize

REASON_UNKNOWN, REASON_ERROR, REASON_EMPTY = "unknown company", "processing error", "empty margin"
KEY = ["site_id", "week", "year"]
RULES = {"company_id": "keep", "margin": "new", "weight": "new"}


@dataclass
class MarginLoad:
    table: DataFrame
    rejects: DataFrame
    stats: DataFrame


def company_key(name):
    """A company name for comparison."""
    return F.lower(C.clean_site_name(name))


def first_sites(sites: DataFrame, companies: DataFrame) -> DataFrame:
    """JOIN-8: (company_key, site_id, company_id, name): the first site of all companies with one normalised name."""
    named = sites.join(companies.select("company_id", F.col("name").alias("_company")), "company_id").filter(F.col("_company").isNotNull())
    return first_per_group(named, company_key(F.col("_company")), "site_id", ["site_id", "company_id", "name"]).withColumnRenamed("_g", "company_key")


def margin_report(weekly: DataFrame, companies: DataFrame) -> DataFrame:
    """The report binding: a text row per weekly fact under its company's name, with prefixes, capitals, blanks and broken values."""
    w = weekly.join(companies.select("company_id", "name"), "company_id")
    k = F.col("site_id") + F.col("run_week")
    name = (F.when(k % 17 == 0, F.concat(F.lit("Otra "), F.col("name"))).when(k % 3 == 0, F.concat(F.lit("Soc. Agricola "), F.col("name")))
            .when(k % 3 == 1, F.upper("name")).otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(" "))))
    margin = F.when(k % 19 == 0, F.lit("n/d")).otherwise(F.regexp_replace(F.format_number("margin", 2), ",", ""))
    return w.select((F.col("site_id") * 100_000 + F.col("run_week")).alias("row_no"), name.alias("Empresa"),
                    F.when(k % 23 == 0, F.lit("x")).otherwise(F.col("week").cast("string")).alias("N° Semana"),
                    F.when(F.col("run_week") % 10 != 0, F.col("year").cast("string")).alias("Año"), margin.alias("(I) MDAT"),
                    F.when(k % 29 != 0, F.col("weight").cast("string")).alias("Vacas en ordeña"))


def load_margins(report: DataFrame, first: DataFrame, stored: DataFrame, default_year: int) -> MarginLoad:
    """MRG-4: upsert the report's margins into ``stored`` (site_id, week, year, company_id, margin, weight)."""
    def blank(c):
        return F.coalesce(C.strip_ws(F.col(f"`{c}`")), F.lit("")) == ""

    rows = report.select(
        "row_no", F.col("Empresa").alias("company"), company_key(F.col("Empresa")).alias("company_key"), C.safe_int("`N° Semana`").alias("week"),
        F.when(blank("Año"), F.lit(default_year)).otherwise(C.safe_int("`Año`")).alias("year"), blank("Año").alias("_no_year"),
        C.safe_float("`(I) MDAT`").alias("margin"), blank("(I) MDAT").alias("_no_margin"),
        C.safe_int("`Vacas en ordeña`").alias("weight"), blank("Vacas en ordeña").alias("_no_weight"))
    known = first.select("company_key", "site_id", "company_id")
    fine = (F.col("week").between(1, 53) & F.col("year").between(1, 9999) & (F.col("_no_margin") | C.in_range("margin"))
            & (F.col("_no_weight") | F.col("weight").isNotNull()))
    reason = (F.when(F.col("site_id").isNull(), REASON_UNKNOWN).when(~F.coalesce(fine, F.lit(False)), REASON_ERROR).when(F.col("_no_margin"), REASON_EMPTY))
    tagged = materialize(rows.join(known, "company_key", "left").withColumn("reason", reason), "margin-rows")
    good = tagged.filter("reason IS NULL").select("site_id", F.col("week").cast("int"), F.col("year").cast("int"), "company_id", "margin", F.col("weight").cast("long"), "row_no")
    table = upsert(stored.select(*KEY, *RULES), good, KEY, RULES, order_col="row_no", partition_col="year")
    loaded = F.col("reason").isNull()
    stats = tagged.agg(F.count(F.lit(1)).alias("rows"), F.count_if(loaded).alias("loaded"), F.count_if(~loaded).alias("omitted"),
                       F.count_distinct(F.when(loaded, F.struct("week", "year"))).alias("unique_weeks"))
    return MarginLoad(table, tagged.filter(~loaded).select("row_no", "company", "reason"), stats)
