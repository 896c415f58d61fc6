"""The whole weekly load (QLT-9): wide reports into daily facts, weekly facts, rejects and statistics.

    reports -> cells (SRC-1, RSH-2) -> parsed, tagged with reject reasons (QLT-2)
            -> written once, counted on the way (``observe``, QLT-6)
            -> companies and sites got or created (JOIN-7)
            -> daily upsert (MRG-1), weekly values (AGG-4) and their upsert (MRG-2), rejects and summary (SNK-3)

All results read the one written copy of the tagged cells, so a report is parsed once and every result sees the same
rows. ``commit_load`` publishes the four tables by one commit; only partitions that the load touches are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weekcraft.functions import clean as C
from weekcraft.operators.merge import get_or_create, upsert
from weekcraft.operators.publish import publish, read_published
from weekcraft.plans import report as R
from weekcraft.plans.daily import DAILY_KEY, dedupe_daily
from weekcraft.session import materialize
from weekcraft.sources.reports import REQUIRED_LOAD, to_cells, validate

DAILY_RULES = {"company_id": "keep", "category": "keep", "value": "new"}
WEEKLY_KEY = ["site_id", "year", "week"]
MEASURES = [*R.WEEKLY_TARGETS, "greens"]
WEEKLY_RULES = {"company_id": "keep", "period_start": "new", "period_end": "new"} | dict.fromkeys(MEASURES, "coalesce")
DAILY_SCHEMA = "site_id long, day date, concept string, company_id long, category string, value double"
WEEKLY_SCHEMA = "site_id long, year int, week int, company_id long, period_start date, period_end date, " + ", ".join(f"{m} double" for m in MEASURES)
REJECTS_SCHEMA = "report_row string, company_code string, site_raw string, concept_raw string, day_text string, cell_text string, reason string"
STATS_SCHEMA = ("cells long, rows long, daily_rows long, weekly_rows long, rejected_cells long, omitted_rows long, companies_created long, "
                "sites_created long, unique_weeks long, unique_sites long")


@dataclass
class WeeklyLoad:
    """What a load gives: the dimensions with new members, the facts after the load, rejected cells, one row of statistics."""
    companies: DataFrame
    sites: DataFrame
    daily: DataFrame
    weekly: DataFrame
    rejects: DataFrame
    stats: DataFrame


def cells_of(reports: list[DataFrame]) -> DataFrame:
    """RSH-2: the cells of wide reports; ``report_row`` tells rows of all reports apart. A report without the
    required columns, dates or rows is refused (SCH-3)."""
    for report in reports:
        if errors := validate(report, REQUIRED_LOAD):
            raise ValueError("; ".join(errors))
    parts = [to_cells(r).withColumn("report_row", F.concat_ws(":", F.lit(str(i)), F.col("row_no").cast("string"))) for i, r in enumerate(reports)]
    return reduce(DataFrame.unionByName, parts)


def load_reason():
    """QLT-2 with the checks of a row's company and site before those of its cells."""
    return (F.when(F.coalesce(F.col("company_code"), F.lit("")) == "", F.lit("empty company"))
             .when(F.coalesce(F.col("site"), F.lit("")) == "", F.lit("empty site"))
             .otherwise(R.reject_reason()))


def process_weekly(cells: DataFrame, companies: DataFrame, sites: DataFrame, daily: DataFrame | None = None,
                   weekly: DataFrame | None = None) -> WeeklyLoad:
    """QLT-9 over the cells of any number of reports.

    companies: (company_id, code, name); sites: (site_id, company_id, name); daily, weekly: the stored facts.
    The counters of cells come from the job that writes the tagged cells: its tasks end its job, so a task that runs
    twice is counted once.
    """
    spark = cells.sparkSession
    counted = Observation("weekly_load")
    tagged = R.parse_cells(cells).withColumn("reason", load_reason())
    staged = materialize(tagged.observe(counted, F.count(F.lit(1)).alias("cells"), F.count_if(F.col("reason").isNull()).alias("valid")), "weekly-load")

    named = staged.filter((F.col("company_code") != "") & (F.col("site") != ""))
    codes = materialize(get_or_create(companies.select("code", F.col("company_id").cast("long").alias("company_id")),
                                      named.select(F.col("company_code").alias("code")), ["code"], "company_id"), "companies")
    members = named.join(codes, F.col("company_code") == F.col("code")).select("company_id", F.col("site").alias("name"))
    known = materialize(get_or_create(sites.select(F.col("company_id").cast("long").alias("company_id"), "name", "site_id"), members,
                                      ["company_id", "name"], "site_id"), "sites")
    ids = known.join(codes, "company_id").select(F.col("code").alias("company_code"), F.col("name").alias("site"), "company_id", "site_id")
    rows = named.join(ids, ["company_code", "site"])

    batch = dedupe_daily(rows.filter(F.col("reason").isNull()).select(
        "site_id", "day", "concept", "company_id", "category", "value", F.struct("row_no", "report_row").alias("row_no"))).drop("row_no")
    stored = daily if daily is not None else spark.createDataFrame([], DAILY_SCHEMA)
    daily_after = upsert(stored, batch, DAILY_KEY, DAILY_RULES, partition_col="day")

    period = staged.groupBy("year", "week").agg(F.min("day").alias("period_start"), F.max("day").alias("period_end"))
    values = (R.weekly_from_report(rows, by=("site_id", "company_id")).join(period, ["year", "week"])
              .filter(F.coalesce(*MEASURES).isNotNull()).select(*WEEKLY_KEY, *WEEKLY_RULES))
    values = materialize(values, "weekly-values")
    weekly_after = upsert(weekly if weekly is not None else spark.createDataFrame([], WEEKLY_SCHEMA), values, WEEKLY_KEY, WEEKLY_RULES, partition_col="year")

    fine = F.col("bad") < F.col("n")
    every_row = staged.groupBy("report_row", "year", "week", "company_code", "site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
    per_row = every_row.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("bad") > 0).alias("omitted_rows"),
                            F.count_distinct(F.when(fine, F.struct("year", "week"))).alias("unique_weeks"),
                            F.count_distinct(F.when(fine, F.struct("company_code", "site"))).alias("unique_sites")).first()
    created = {c: after.count() - before.select(k).count() for c, after, before, k in (("companies", codes, companies, "company_id"), ("sites", known, sites, "site_id"))}
    got = counted.get
    stats = {"cells": got["cells"], "rows": per_row["rows"], "daily_rows": got["valid"], "weekly_rows": values.count(), "rejected_cells": got["cells"] - got["valid"],
             "omitted_rows": per_row["omitted_rows"], "companies_created": created["companies"], "sites_created": created["sites"],
             "unique_weeks": per_row["unique_weeks"], "unique_sites": per_row["unique_sites"]}

    names = codes.join(companies.select("company_id", "name"), "company_id", "left").select(
        "company_id", "code", F.coalesce("name", F.concat(F.lit("Empresa "), F.col("code"))).alias("name"))
    large = F.when(F.col("total_large"), F.lit(R.REASON_LARGE_TOTAL))
    reject_columns = [F.col(c) for c in ("company_code", "site_raw", "concept_raw")]
    row_id = F.col("report_row").cast("string").alias("report_row")
    totals = staged.groupBy("report_row").agg(F.first(F.struct(*reject_columns, "total_text", large.alias("reason"))).alias("r")).filter("r.reason IS NOT NULL")
    rejects = staged.filter(F.col("reason").isNotNull()).select(row_id, *reject_columns, "day_text", "cell_text", "reason").unionByName(
        totals.select(row_id, "r.company_code", "r.site_raw", "r.concept_raw", F.lit(None).cast("string").alias("day_text"),
                      F.col("r.total_text").alias("cell_text"), "r.reason"))
    return WeeklyLoad(names, known.select("site_id", "company_id", "name"), daily_after, weekly_after, rejects,
                      spark.createDataFrame([tuple(int(stats[f.split()[0]]) for f in STATS_SCHEMA.split(", "))], STATS_SCHEMA))


def commit_load(spark: SparkSession, store: str, reports: list[DataFrame], companies: DataFrame, sites: DataFrame, load: str) -> WeeklyLoad:
    """Load reports into a store: its stored facts are read, all results published by one commit (SNK-3 included).

    Daily facts are kept by day, weekly facts by year. Only partitions of the reports' days and years are read and written;
    a load that is run again under its id, after a stop at any point, gives the same store.
    """
    cells = materialize(cells_of(reports), "cells")
    days = [r[0] for r in cells.select(C.parse_day("day_text").alias("d")).distinct().collect()]  # a report's headers: as many as it is wide
    years = [r[0] for r in cells.select("year").distinct().collect()]
    result = process_weekly(cells, companies, sites, read_published(spark, store, "daily", DAILY_SCHEMA, only=days),
                            read_published(spark, store, "weekly", WEEKLY_SCHEMA, only=years))
    publish(spark, store, {"companies": (result.companies, None), "sites": (result.sites, None), "daily": (result.daily, "day"), "weekly": (result.weekly, "year"),
                           "rejects": (result.rejects.withColumn("load", F.lit(load)), "load"), "stats": (result.stats.withColumn("load", F.lit(load)), "load")}, load=load)
    return result
