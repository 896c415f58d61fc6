"""Administrative jobs over the same tables (JOIN-3..6, AGG-5..12, AGG-14, SRT-4, FLT-6,
FLT-8, FLT-10, MAP-1).

Counts across one-to-many relations are computed by pre-aggregating each fact on its key
first and joining the small aggregates afterwards, so no join fans rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.functions import clean as C

# Fixed values that must equal the reference's: log status -> symbol, with a default.
STATUS_SYMBOLS = {"exito": "✅", "error": "❌", "warning": "⚠️"}
STATUS_DEFAULT = "❓"


def company_counts(companies: DataFrame, sites: DataFrame, grants: DataFrame) -> DataFrame:
    """JOIN-3: sites and users per company, each side pre-aggregated (no fan-out)."""
    s = sites.groupBy("company_id").agg(F.count_distinct("site_id").alias("n_sites"))
    g = grants.groupBy("company_id").agg(F.count_distinct("user_id").alias("n_users"))
    return (companies.join(s, "company_id", "left").join(g, "company_id", "left")
                     .select("company_id", "name", "code",
                             F.coalesce("n_sites", F.lit(0)).cast("bigint").alias("n_sites"),
                             F.coalesce("n_users", F.lit(0)).cast("bigint").alias("n_users"),
                             C.key_label(F.col("name"), F.col("code")).alias("label")))


def site_counts(sites: DataFrame, weekly: DataFrame, daily: DataFrame) -> DataFrame:
    """JOIN-4: weeks with weekly data and days with daily data per site (pre-aggregated)."""
    w = weekly.groupBy("site_id").agg(F.count_distinct("year", "week").alias("n_weeks"))
    d = daily.groupBy("site_id").agg(F.count_distinct("day").alias("n_days"), F.count(F.lit(1)).alias("n_daily"))
    return (sites.join(w, "site_id", "left").join(d, "site_id", "left")
                 .select("site_id", "name",
                         *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ["n_weeks", "n_days", "n_daily"]]))


def user_companies(users: DataFrame, grants: DataFrame, companies: DataFrame) -> DataFrame:
    """JOIN-5 + AGG-9: companies of each user as ``name, name`` in name order.

    A user's list is bounded by the company dimension, not by fact volume.
    """
    g = grants.join(companies.select("company_id", "name"), "company_id")
    agg = g.groupBy("user_id").agg(
        F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY name)").alias("companies"),
        F.count(F.lit(1)).cast("bigint").alias("n_companies"))
    return (users.join(agg, "user_id", "left")
                 .select("user_id", "username", "active", "companies",
                         F.coalesce("n_companies", F.lit(0)).cast("bigint").alias("n_companies"),
                         C.map_value(F.col("active"), {"true": "✅", "false": "❌"}, "❓").alias("active_symbol")))


def recent_logs(logs: DataFrame, users: DataFrame, limit: int = 100, file_types: list[str] | None = None,
                statuses: list[str] | None = None) -> DataFrame:
    """JOIN-6 + SRT-4 + FLT-8 + MAP-1 + DT-2: the newest ``limit`` loads that match the optional
    type/status filters (empty = all); the top-k is the feature, ``log_id`` breaks ties."""
    if file_types:
        logs = logs.filter(F.col("file_type").isin(*file_types))
    if statuses:
        logs = logs.filter(F.col("status").isin(*statuses))
    newest = (F.col("loaded_at").desc(), F.col("log_id").desc())
    top = logs.orderBy(*newest).limit(limit).join(users.select("user_id", "username"), "user_id", "left").orderBy(*newest)
    return top.select("log_id", C.ts_text(F.col("loaded_at")).alias("loaded_at"), "username", "file_type",
                      "file_name", "processed", "status",
                      C.map_value(F.col("status"), STATUS_SYMBOLS, STATUS_DEFAULT).alias("status_symbol"), "message")


def log_counters(logs: DataFrame) -> DataFrame:
    """AGG-11: total / success / error loads per file type (one aggregate)."""
    return logs.groupBy("file_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(F.col("status") == "exito").cast("bigint").alias("success"),
        F.count_if(F.col("status") == "error").cast("bigint").alias("errors"))


def history_summary(hist: DataFrame) -> DataFrame:
    """AGG-6: distinct weeks, distinct sites, first and last day of the history."""
    return hist.agg(F.count_distinct("week").cast("bigint").alias("weeks"),
                    F.count_distinct("site").cast("bigint").alias("sites"),
                    F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                    F.count(F.lit(1)).cast("bigint").alias("rows"))


def distinct_by_sketch(rows: DataFrame, group: str, value: str, lg_k: int = 12) -> DataFrame:
    """AGG-6 / AGG-13 approximate: one row per group and one (null) for all: exact and within_bound, merged_equal.

    A sketch per group has 2**lg_k registers whatever the group holds; those of the groups merge to the sketch of all rows.
    within_bound: the estimate is within three standard errors (1.04 / sqrt(2**lg_k)) of the exact count, or one apart.
    """
    bound = 3 * 1.04 / 2 ** (lg_k / 2)
    per = rows.groupBy(group).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"), F.count_distinct(value).alias("exact"))
    merged = per.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merged"))
    whole = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(lg_k))).alias("estimate"), F.count_distinct(value).alias("exact")).crossJoin(merged)  # one row each

    def near(estimate):
        return F.abs(estimate - F.col("exact")) <= F.greatest(F.lit(1.0), bound * F.col("exact"))

    each = per.select(F.col(group).cast("long").alias("group"), "exact", near(F.hll_sketch_estimate("sketch")).alias("within_bound"), F.lit(True).alias("merged_equal"))
    return each.unionByName(whole.select(F.lit(None).cast("long").alias("group"), "exact", near(F.col("estimate")).alias("within_bound"),
                                         (F.abs(F.col("merged") - F.col("estimate")) <= F.greatest(F.lit(1.0), bound * F.col("exact"))).alias("merged_equal")))


def live_sessions(sessions: DataFrame, as_of: str, idle_days: int = 7) -> DataFrame:
    """DEL-5: sessions (expires_at, active, session_end) without those expired, and without inactive ones of over ``idle_days``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    gone = (F.col("expires_at") < now) | (~F.col("active") & (F.col("session_end") < now - F.expr(f"INTERVAL {idle_days} DAYS")))
    return sessions.filter(~F.coalesce(gone, F.lit(False)))


def weeks_available(hist: DataFrame, limit: int = 100) -> DataFrame:
    """AGG-7: per week the closing day, rows and sites; newest ``limit`` weeks (top-k)."""
    return (hist.groupBy("week").agg(F.max("day").alias("last_day"), F.count(F.lit(1)).cast("bigint").alias("rows"),
                                     F.count_distinct("site").cast("bigint").alias("sites"))
                .orderBy(F.col("week").desc()).limit(limit))


def week_detail(hist: DataFrame, week: int | None = None, day=None) -> DataFrame:
    """FLT-6: rows of one closing day (priority) or one week; neither gives no rows."""
    if day is not None:
        return hist.filter(F.col("day") == F.lit(day).cast("date"))
    if week is not None:
        return hist.filter(F.col("week") == week)
    return hist.limit(0)


def data_summary(counts: dict[str, DataFrame], weekly: DataFrame, daily: DataFrame) -> DataFrame:
    """AGG-5 + AGG-8 + AGG-14: one (item, value) row per table count, plus the latest week
    key (``year*100+week`` of the latest (year, week)) and the latest daily day (yyyymmdd)."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("value")).select(F.lit(name).alias("item"), "value")
             for name, df in counts.items()]
    lw = weekly.agg(F.max(F.struct("year", "week")).alias("m")).select(
        F.lit("latest_week_key").alias("item"), C.week_key(F.col("m.year"), F.col("m.week")).cast("bigint").alias("value"))
    ld = daily.agg(F.max("day").alias("m")).select(
        F.lit("latest_day").alias("item"), F.date_format("m", "yyyyMMdd").cast("bigint").alias("value"))
    out = parts[0]
    for p in parts[1:] + [lw, ld]:
        out = out.unionByName(p)
    return out


def distinct_values(daily: DataFrame, weekly: DataFrame, sites: DataFrame) -> DataFrame:
    """AGG-12 + FLT-10: sorted distinct days, periods (non-null), site names, categories and
    concepts, as (kind, value) rows."""
    days = daily.select(F.lit("day").alias("kind"), C.day_text(F.col("day")).alias("value"))
    periods = (weekly.filter(F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
                     .select(F.lit("period").alias("kind"), C.period_label("period_start", "period_end").alias("value")))
    names = sites.select(F.lit("site").alias("kind"), F.col("name").alias("value"))
    cats = daily.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    concepts = daily.select(F.lit("concept").alias("kind"), F.col("concept").alias("value"))
    return days.unionByName(periods).unionByName(names).unionByName(cats).unionByName(concepts).distinct() \
               .orderBy("kind", "value")


def run_maintenance(logs: DataFrame, tables: dict[str, DataFrame], as_of: str, retention_days: int = 90):
    """MNT-1 / UDF-3: the maintenance run as a DataFrame of (task, result, duration_ms).

    Retention counts the logs older than ``retention_days`` before ``as_of`` (DEL-5), then
    table statistics are refreshed (row count per table; catalog tables would use
    ``ANALYZE TABLE ... COMPUTE STATISTICS``)."""
    import time
    spark = logs.sparkSession
    rows = []
    t0 = time.time()
    old = F.col("loaded_at") < F.date_sub(F.lit(as_of).cast("date"), retention_days)
    removed = logs.agg(F.count_if(old).alias("n")).first()["n"]
    rows.append(("retention_logs", f"{removed} removed", int((time.time() - t0) * 1000)))
    for name, df in tables.items():
        t0 = time.time()
        n = df.count()
        rows.append((f"statistics_{name}", f"{n} rows", int((time.time() - t0) * 1000)))
    return spark.createDataFrame(rows, "task string, result string, duration_ms long")


def weeks_by_date(hist: DataFrame) -> DataFrame:
    """AGG-7 variant: rows and sites per (week, closing day), all of them, newest day first."""
    return (hist.groupBy("week", "day").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                            F.count_distinct("site").cast("bigint").alias("sites"))
                .orderBy(F.col("day").desc(), F.col("week").desc()))
