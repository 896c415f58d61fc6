"""Daily facts: the deduplicated daily table, its day pivot and the secured detail view
(SRC-6, RSH-3, RSH-4, RSH-9, NUM-5, FLT-5, FLT-7, SRT-3, JOIN-2, DT-2, DT-6, SEC-2)."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.functions.clean import day_text
from weekcraft.operators.reshape import pivot_days
from weekcraft.operators.security import secure
from weekcraft.sources import bindings as B
from weekcraft.sources.tables import Tables

DAILY_KEY = ["site_id", "day", "concept"]


def dedupe_daily(batch: DataFrame, order_col: str = "row_no") -> DataFrame:
    """Sequential-upsert semantics inside one batch (WIN-7 / MRG-1): per key the first
    row's category and the last row's value. Two ``min_by``/``max_by`` aggregates, reduced
    map-side before the shuffle, so a hot key never lands whole in one task."""
    return (batch.groupBy(*DAILY_KEY)
                 .agg(F.min_by("company_id", order_col).alias("company_id"),
                      F.min_by("category", order_col).alias("category"),
                      F.max_by("value", order_col).alias("value"),
                      F.max(order_col).alias(order_col)))


def daily_table(t: Tables) -> DataFrame:
    """The stored daily fact: events loaded in event order, keyed by (site, day, concept)."""
    return dedupe_daily(B.daily(t))


def period_days(first: date, days: int) -> list[date]:
    """The calendar days of a period, in order (DT-6)."""
    return [first + timedelta(days=i) for i in range(days)]


def _in_period(daily: DataFrame, days: list[date]) -> DataFrame:
    """Rows of the period, with their header text; the bounds reach the scan as day literals."""
    return (daily.filter(F.col("day").between(F.lit(days[0]), F.lit(days[-1]))).withColumn("day_text", day_text(F.col("day"))))


def row_total_of(cols: list[str], decimals: int = 2):
    """RSH-4: sum of the day cells, nulls skipped, all-null 0; exact for 2-decimal values."""
    if not cols:
        return F.lit(0.0)
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols])
    f = float(10 ** decimals)
    return F.round(s * f, 0) / f


def daily_pivot(daily: DataFrame, days: list[date], keys: list[str] | None = None) -> DataFrame:
    """RSH-3 + RSH-4: one row per key with facts in the period, one column per day of it, plus the row total.

    The columns come from the period, so the data are read once and the schema is fixed.
    """
    keys = keys or ["site_id", "category", "concept"]
    names = [f"{d:%d-%m-%Y}" for d in days]
    pv = pivot_days(_in_period(daily, days), keys, "day_text", "value", names, order_col="row_no" if "row_no" in daily.columns else None)
    return pv.withColumn("total", row_total_of(names))


def daily_detail(t: Tables, user_id: int | None, days: list[date], is_admin: bool = False,
                 categories: list[str] | None = None, concepts: list[str] | None = None,
                 site: str | None = None) -> DataFrame:
    """SRC-6 / RSH-9: secured daily facts joined to site names, optional filters
    (FLT-7 assembled from the given arguments), pivoted by day, nulls shown as 0 (NUM-5),
    sorted by site, category, concept (SRT-3)."""
    d = secure(daily_table(t), B.grants(t), user_id, is_admin)
    s = B.sites(t).select("site_id", F.col("name").alias("site"))
    d = d.join(s, "site_id")
    preds = [F.lit(True)]
    if categories:
        preds.append(F.col("category").isin(*categories))
    if concepts:
        preds.append(F.col("concept").isin(*concepts))
    if site:
        preds.append(F.col("site") == site)
    d = d.filter(reduce(lambda a, b: a & b, preds))
    names = [f"{x:%d-%m-%Y}" for x in days]
    pv = pivot_days(_in_period(d, days), ["site", "category", "concept"], "day_text", "value", names, order_col="row_no")
    return pv.fillna(0.0, subset=names).withColumn("total", row_total_of(names)).orderBy("site", "category", "concept")


def secured_daily(t: Tables, user_id: int | None, is_admin: bool = False) -> DataFrame:
    """SEC-2: secured daily facts with site and company names."""
    d = secure(daily_table(t), B.grants(t), user_id, is_admin)
    s = B.sites(t).select("site_id", F.col("name").alias("site"))
    c = B.companies(t).select("company_id", F.col("name").alias("company"))
    return d.join(s, "site_id").join(c, "company_id").select(
        "company", "site", "day", "category", "concept", "value")
