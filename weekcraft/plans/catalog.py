"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

Each entry reads the driver tables under ``sf_dir`` through the bindings and runs one of
the library's plans over the whole tables.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcraft.functions.clean import rnd
from weekcraft.plans import matrix as M
from weekcraft.sources import bindings as B
from weekcraft.sources.tables import Tables
from weekcraft.functions import clean as C
from weekcraft.functions.concepts import attach_concept_key
from weekcraft.operators import aggregates as A
from weekcraft.operators.rank import global_rank, global_ranks, window_rank
from weekcraft.operators.windows import trailing_actual, trailing_fixed, trailing_series
from weekcraft.session import materialize
from weekcraft.operators.security import visible_sites
from weekcraft.plans import daily as D
from weekcraft.plans import report as R
from weekcraft.plans import margin_load as ML
from weekcraft.plans import weekly_load as WL
from weekcraft.plans import admin as AD
from weekcraft.operators import merge as MG
from weekcraft.plans import history as H
from weekcraft.plans import history_store as HS
from weekcraft.streaming.lockouts import lockouts as _lockouts
from weekcraft.streaming.sessions import sessions as _sessions, slice_seconds

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


@register("weekly_matrix")
def q_weekly_matrix(spark, sf_dir) -> DataFrame:
    """RSH-7 flagship: the latest week's site x metric matrix with ranks and the weighted total row."""
    return M.weekly_matrix(_t(spark, sf_dir))


@register("weekly_long")
def q_weekly_long(spark, sf_dir) -> DataFrame:
    """SRC-5/RSH-1/JOIN-1/FLT-3: the latest week's facts as (company, site, concept, total) rows."""
    t = _t(spark, sf_dir)
    long = M.weekly_long(t)
    return long.select("company", "company_code", "site", F.col("week").cast("int").alias("week"), "concept",
                       rnd("total").alias("total"))


# --------------------------------------------------------------------------- weekly fact family


def _round_doubles(df: DataFrame) -> DataFrame:
    """Round every double column with the engine-independent 6-digit rounding."""
    return df.select(*[C.rnd(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@register("weighted_totals")
def q_weighted_totals(spark, sf_dir) -> DataFrame:
    """AGG-2/AGG-3 per week over all sites of the weekly fact (DRV-3..5 on the totals)."""
    t = _t(spark, sf_dir)
    wk = B.weekly(t)
    tot = M.total_row(wk, group_cols=["year", "week"], history=False).drop("site", "rank_margin", "rank_4w",
                                                                        "rank_52w")
    return _round_doubles(tot)


@register("derived_metrics")
def q_derived_metrics(spark, sf_dir) -> DataFrame:
    """DRV-1..7 as row expressions over every weekly row."""
    t = _t(spark, sf_dir)
    w = B.weekly(t)
    pasture = F.when(F.col("run_week") % 3 != 0, F.col("ms_cons") / 2)
    green = F.when(F.col("run_week") % 4 != 0, F.col("ms_conc") / 4)
    out = w.select(
        "site_id", "run_week",
        A.greens_expr("greens", pasture, green).alias("greens_fixed"),
        A.total_ms_expr(A.greens_expr("greens", pasture, green), "ms_cons", "ms_conc").alias("total_ms_calc"),
        A.margin_expr("price", "prod", "cost").alias("margin_calc"),
        A.margin_per_litre("price", "prod", "cost").alias("margin_l"),
        A.stocking_expr("herd", "area").alias("stocking"),
        A.cost_share("price", "prod", "cost").alias("cost_pct"),
        A.greens_weekly(pasture, green).alias("greens_weekly"))
    return _round_doubles(out)


def _hist(t: Tables) -> DataFrame:
    return B.history(t)


@register("trailing_actual")
def q_trailing_actual(spark, sf_dir) -> DataFrame:
    """WIN-4: per site, 4/52-week means anchored at the site's own latest week."""
    return _round_doubles(trailing_actual(_hist(_t(spark, sf_dir))))


@register("trailing_fixed")
def q_trailing_fixed(spark, sf_dir) -> DataFrame:
    """WIN-5: SUM/4 and SUM/52 over the rows strictly before each history row's day."""
    h = _hist(_t(spark, sf_dir)).select("site", "week", "day", "margin", "weight")
    return _round_doubles(trailing_fixed(h))


@register("trailing_series")
def q_trailing_series(spark, sf_dir) -> DataFrame:
    """WIN-6: rolling 4/52-week means at every week of every site."""
    h = _hist(_t(spark, sf_dir)).select("site", "week", "margin", "weight")
    return _round_doubles(trailing_series(h))


@register("history_window")
def q_history_window(spark, sf_dir) -> DataFrame:
    """SRC-7/SRC-8/SRC-9 + JOIN-9: history of the 52 weeks before the latest week, by
    trimmed site name joined to its company; measures as double."""
    t = _t(spark, sf_dir)
    h = HS.stored_history(spark, t, sf_dir)
    weeks = HS.weeks_before(h, 52)  # 52 rows at most; the join prunes the scan to their partitions
    c = B.companies(t).select("company_id", F.col("name").alias("company"))
    out = h.join(F.broadcast(weeks), "week").join(c, "company_id").select(
        "week", "day", C.strip_ws("site").alias("site"), "company", F.col("margin").cast("double").alias("margin"), F.col("weight").cast("double").alias("weight"))
    return _round_doubles(out)


def _weekly_named(t: Tables) -> DataFrame:
    s = B.sites(t).select("site_id", F.col("name").alias("site"))
    return B.weekly(t).join(s, "site_id").select("site_id", "site", "company_id", "year", "week", "margin")


@register("rank_all_weeks")
def q_rank_all_weeks(spark, sf_dir) -> DataFrame:
    """WIN-1: RANK() OVER (ORDER BY margin DESC NULLS LAST) across all weeks; nulls ranked.

    Always the two-phase plan (no single-task window), on the materialised weekly rows.
    """
    w = materialize(_weekly_named(_t(spark, sf_dir)), "weekly-named")
    return _round_doubles(global_rank(w, "margin", "rank", descending=True, keep_null=False))


@register("rank_nulls_kept")
def q_rank_nulls_kept(spark, sf_dir) -> DataFrame:
    """WIN-2 over all weekly rows: min-rank descending, null margins keep a null rank."""
    w = materialize(_weekly_named(_t(spark, sf_dir)), "weekly-named")
    return _round_doubles(global_ranks(w, [("margin", "rank")], descending=True, keep_null=True))


@register("rank_per_week")
def q_rank_per_week(spark, sf_dir) -> DataFrame:
    """WIN-3: rank within each (year, week), nulls last and ranked."""
    w = _weekly_named(_t(spark, sf_dir))
    return _round_doubles(window_rank(w, "margin", "rank", ["year", "week"]))


@register("concept_metric")
def q_concept_metric(spark, sf_dir) -> DataFrame:
    """STR-2 + STR-5 + AGG-1: dirty concept spellings -> keys -> mean per (site, key), all weeks."""
    t = _t(spark, sf_dir)
    from weekcraft.functions.concepts import WEEKLY_MEASURE_LABELS
    from weekcraft.operators.reshape import unpivot_measures
    w = B.weekly(t).join(B.sites(t).select("site_id", F.col("name").alias("site")), "site_id")
    long = unpivot_measures(w, ["site", "run_week"], WEEKLY_MEASURE_LABELS, keep_null=("Praderas y otros verdes",))
    v = F.col("run_week") % 4
    dirty = (F.when(v == 0, F.col("concept"))
              .when(v == 1, F.upper("concept"))
              .when(v == 2, C.fold_text(F.col("concept")))
              .otherwise(F.concat(F.lit("(A)  "), F.col("concept"), F.lit(" "))))
    # Rows of one site and spelling are summed first, so that a spelling is cleaned and keyed once per site, not once per row.
    spelled = long.withColumn("concept", dirty).groupBy("site", "concept").agg(*A.dec_parts("total"), F.count(F.lit(1)).alias("n"))
    keyed = attach_concept_key(spelled.withColumn("concept", C.clean_concept("concept")), "concept", "concept_key")
    out = keyed.groupBy("site", "concept_key").agg(A.dec_avg_of_parts().alias("metric"), F.sum("n").alias("n"))
    return _round_doubles(out)


def _matrix(t: Tables) -> DataFrame:
    return M.weekly_matrix(t)


@register("cell_flags")
def q_cell_flags(spark, sf_dir) -> DataFrame:
    """DRV-8: each body cell compared with the total row: 'good' / 'bad' / ''."""
    m = _matrix(_t(spark, sf_dir))
    return M.cell_flags(m)


@register("format_matrix")
def q_format_matrix(spark, sf_dir) -> DataFrame:
    """FMT-3/FMT-4: the matrix as display text, per-column formats."""
    return M.format_matrix(_matrix(_t(spark, sf_dir)))


@register("weekly_matrix_selected")
def q_weekly_matrix_selected(spark, sf_dir) -> DataFrame:
    """FLT-1/FLT-2/SET-4/JSON-1: matrix restricted to configured sites (selection read from a
    JSON config value: minimum area), intersected with available ones; empty -> all."""
    t = _t(spark, sf_dir)
    cfg = spark.createDataFrame([("matrix_selection", '{"min_area": 30}')], "key string, value string")
    return M.weekly_matrix_selected(t, cfg)


# --------------------------------------------------------------------------- daily facts and security

DETAIL_USER, SECURED_USER = 1, 2
# The period of the day pivots (a parameter of the operators): the month of the events.
DETAIL_DAYS = D.period_days(date(2024, 1, 1), 30)
DETAIL_CATEGORIES = ["activity", "sales"]


@register("daily_pivot")
def q_daily_pivot(spark, sf_dir) -> DataFrame:
    """RSH-3/RSH-4: stored daily facts, one column per day, plus the row total."""
    return D.daily_pivot(D.daily_table(_t(spark, sf_dir)), DETAIL_DAYS)


@register("daily_detail")
def q_daily_detail(spark, sf_dir) -> DataFrame:
    """SRC-6/RSH-9: a user's secured daily detail, category filter, zeros for gaps."""
    return D.daily_detail(_t(spark, sf_dir), DETAIL_USER, DETAIL_DAYS, categories=DETAIL_CATEGORIES)


@register("secured_daily")
def q_secured_daily(spark, sf_dir) -> DataFrame:
    """SEC-1/SEC-2/SEC-4: daily facts visible to one (non-admin) user."""
    return D.secured_daily(_t(spark, sf_dir), SECURED_USER, False)


@register("visible_sites")
def q_visible_sites(spark, sf_dir) -> DataFrame:
    """SEC-3/JOIN-10/JOIN-11: sites visible to every active user."""
    t = _t(spark, sf_dir)
    return visible_sites(B.sites(t).select("site_id", "name", "company_id"), B.grants(t), B.users(t))


def _tagged(spark, sf_dir):
    return R.tagged_cells(_t(spark, sf_dir))


@register("daily_melt")
def q_daily_melt(spark, sf_dir) -> DataFrame:
    """RSH-2/RSH-5/DT-1/DT-4: report cells melted to valid daily facts with totals and period."""
    return R.melt_report(_tagged(spark, sf_dir))


@register("load_rejects")
def q_load_rejects(spark, sf_dir) -> DataFrame:
    """QLT-2: rejected cells with their reason."""
    return R.load_rejects(_tagged(spark, sf_dir))


@register("load_stats")
def q_load_stats(spark, sf_dir) -> DataFrame:
    """QLT-6/AGG-13: processed / inserted / omitted counters and unique weeks, sites, new sites."""
    t = _t(spark, sf_dir)
    return R.load_stats(R.tagged_cells(t), B.sites(t))


@register("unmapped_concepts")
def q_unmapped_concepts(spark, sf_dir) -> DataFrame:
    """QLT-5/SET-3: report concepts no weekly pattern maps."""
    return R.unmapped_concepts(_tagged(spark, sf_dir))


@register("weekly_from_report")
def q_weekly_from_report(spark, sf_dir) -> DataFrame:
    """QLT-9/AGG-4/DRV-7/STR-9: weekly values aggregated from the report rows."""
    return R.weekly_from_report(_tagged(spark, sf_dir))


# --------------------------------------------------------------------------- the whole weekly load

KNOWN_COMPANIES, STORED_WEEKS = 20, 3


def _weekly_load(spark, sf_dir) -> WL.WeeklyLoad:
    """The weekly reports of all daily facts loaded into stored ones.

    Companies below ``KNOWN_COMPANIES`` and their even sites exist before. Every tenth event of an existing site is stored, as 1.0
    in the category 'stored'; the sites' first weeks of 2024 are stored with an area and a weight.
    """
    t = _t(spark, sf_dir)
    companies = B.companies(t).filter(F.col("company_id") < KNOWN_COMPANIES).select("company_id", F.col("company_id").cast("string").alias("code"), "name")
    s = F.col("s_suppkey")
    sites = t.supplier.filter((s % 2 == 0) & (s % 25 < KNOWN_COMPANIES)).select(
        s.alias("site_id"), (s % 25).cast("long").alias("company_id"), F.concat(F.lit("Site "), s.cast("string")).alias("name"))
    written = F.create_map(*[F.lit(x) for kv in R.REPORT_CONCEPTS for x in kv])
    daily = (D.dedupe_daily(B.daily(t).filter(F.col("row_no") % 10 == 0)).join(sites.select("site_id"), "site_id", "left_semi")
             .select("site_id", "day", C.clean_concept(F.element_at(written, F.col("concept"))).alias("concept"), F.col("company_id").cast("long").alias("company_id"),
                     F.lit("stored").alias("category"), F.lit(1.0).alias("value")).filter(F.col("concept").isNotNull()))
    old = F.lit("2000-01-01").cast("date")
    none = F.lit(None).cast("double")
    weekly = sites.select("site_id", "company_id", F.explode(F.sequence(F.lit(1), F.lit(STORED_WEEKS))).alias("week")).select(
        "site_id", F.lit(2024).alias("year"), "week", "company_id", old.alias("period_start"), old.alias("period_end"),
        *[{"area": (10 + F.col("site_id") % 37).cast("double"), "weight": F.lit(5.0)}.get(m, none).alias(m) for m in WL.MEASURES])
    return WL.process_weekly(WL.cells_of(R.wide_reports(t)), companies, sites, daily, weekly)


@register("weekly_load_daily")
def q_weekly_load_daily(spark, sf_dir) -> DataFrame:
    """QLT-9/SRC-1/RSH-2/MRG-1: the daily facts after the load of wide weekly reports."""
    return _weekly_load(spark, sf_dir).daily


@register("weekly_load_weekly")
def q_weekly_load_weekly(spark, sf_dir) -> DataFrame:
    """QLT-9/AGG-4/MRG-2: the weekly facts after the load."""
    return _weekly_load(spark, sf_dir).weekly


@register("weekly_load_sites")
def q_weekly_load_sites(spark, sf_dir) -> DataFrame:
    """QLT-9/JOIN-7: the sites after the load, with the code of their company."""
    load = _weekly_load(spark, sf_dir)
    return load.sites.join(load.companies.select("company_id", F.col("code").alias("company_code"), F.col("name").alias("company")), "company_id")


@register("weekly_load_rejects")
def q_weekly_load_rejects(spark, sf_dir) -> DataFrame:
    """QLT-9/QLT-2/SNK-3: the cells that the load rejects, with their reasons."""
    return _weekly_load(spark, sf_dir).rejects.drop("report_row")


@register("weekly_load_stats")
def q_weekly_load_stats(spark, sf_dir) -> DataFrame:
    """QLT-9/QLT-6/AGG-13: the one-row summary of the load."""
    return _weekly_load(spark, sf_dir).stats


# --------------------------------------------------------------------------- scalar cleaning / formats / dates
def _plain2(c):
    """Number text with 2 decimals and no grouping (built from format_number)."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


@register("clean_numbers")
def q_clean_numbers(spark, sf_dir) -> DataFrame:
    """STR-1/NUM-1..3: locale-formatted number texts generated from every lineitem row, parsed back."""
    li = _t(spark, sf_dir).lineitem
    v = F.col("l_extendedprice")
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 7
    text = (F.when(k == 0, C.fmt_es(v))
             .when(k == 1, F.concat(F.lit("$ "), C.fmt_es(v)))
             .when(k == 2, _plain2(v))
             .when(k == 3, F.regexp_replace(_plain2(v), "[.]", ","))
             .when(k == 4, F.concat(F.regexp_replace(F.format_number(F.col("l_quantity"), 0), ",", ""), F.lit(" %")))
             .when(k == 5, F.regexp_replace(F.format_number(v * 1000, 0), "[.]", ","))
             .otherwise(F.lit("n/a")))
    return li.select("l_orderkey", "l_linenumber", text.alias("text"),
                     C.clean_number(text).alias("value"),
                     C.safe_float(F.col("l_quantity").cast("string")).alias("qty_float"),
                     C.safe_int(_plain2(v)).alias("price_int"))


@register("clean_concepts")
def q_clean_concepts(spark, sf_dir) -> DataFrame:
    """STR-2/STR-9/STR-10: concept texts with (X) prefixes and doubled spaces, from every part."""
    p = _t(spark, sf_dir).part
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.concat(F.lit("(A) "), F.col("p_name")))
            .when(k == 1, F.concat(F.lit("(12)  "), F.regexp_replace("p_name", " ", "  "), F.lit("  ")))
            .when(k == 2, F.lit("(BB) "))
            .otherwise(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))))
    concept = C.clean_concept(raw)
    return p.select("p_partkey", raw.alias("raw"), concept.alias("concept"),
                    F.coalesce(C.contains_ci(concept, "RING"), F.lit(False)).alias("has_ring"),
                    C.equals_ci("p_type", F.lit("economy")).alias("is_economy"))


@register("clean_names")
def q_clean_names(spark, sf_dir) -> DataFrame:
    """STR-3/STR-6/STR-7/STR-8: site names with prefixes, literal replacement, company codes."""
    s = _t(spark, sf_dir).supplier
    k = F.col("s_suppkey") % 6
    raw = (F.when(k == 0, F.concat(F.lit("Fundo "), F.col("s_name")))
            .when(k == 1, F.concat(F.lit("Soc. Agricola "), F.col("s_name")))
            .when(k == 2, F.concat(F.lit("agricola  "), F.col("s_name"), F.lit(" ")))
            .when(k == 3, F.concat(F.lit("Soc. Fundo "), F.col("s_name")))
            .when(k == 4, F.lit("Ag. Los Maitenes"))
            .otherwise(F.col("s_name")))
    replaced = C.replace_literals(raw, C.SITE_LITERAL_REPLACEMENTS)
    code_raw = F.concat(F.col("s_nationkey").cast("string"), F.lit(" _"), F.col("s_name"))
    return s.select("s_suppkey", raw.alias("raw"), C.clean_site_name(replaced).alias("site"),
                    C.company_code(code_raw).alias("company_code"), C.strip_ws(raw).alias("trimmed"))


@register("fold_text")
def q_fold_text(spark, sf_dir) -> DataFrame:
    """STR-4: accent folding of part names written with accents and stray '?'."""
    p = _t(spark, sf_dir).part
    accented = F.translate(F.col("p_name"), "aeiou", "áéíóú")
    raw = (F.when(F.col("p_partkey") % 3 == 0, F.upper(accented))
            .when(F.col("p_partkey") % 3 == 1, F.concat(accented, F.lit("?")))
            .otherwise(F.concat(F.lit("ñandú "), F.col("p_brand"))))
    return p.select("p_partkey", raw.alias("raw"), C.fold_text(raw).alias("folded"))


@register("format_spanish")
def q_format_spanish(spark, sf_dir) -> DataFrame:
    """FMT-1/FMT-2/STR-11: Spanish number, money, percent and integer texts for every lineitem."""
    li = _t(spark, sf_dir).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     C.fmt_es(F.col("l_extendedprice")).alias("price_es"),
                     C.fmt_money(F.col("l_extendedprice") * F.col("l_discount")).alias("discount_money"),
                     C.fmt_pct(F.col("l_tax") * 100).alias("tax_pct"),
                     C.fmt_int(F.col("l_quantity")).alias("qty_int"),
                     C.fmt_es(F.when(F.col("l_linenumber") != 1, -F.col("l_discount"))).alias("neg_or_blank"),
                     C.key_label(F.col("l_returnflag"), F.col("l_linestatus")).alias("flag_label"))


@register("iso_week")
def q_iso_week(spark, sf_dir) -> DataFrame:
    """DT-2/DT-3/DT-7: ISO week and ISO year (and the calendar-year variant), week key, texts."""
    o = _t(spark, sf_dir).orders
    d = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey",
                    C.iso_week(d).cast("int").alias("iso_week"),
                    C.iso_year(d).cast("int").alias("iso_year"),
                    F.year(d).alias("calendar_year"),
                    C.week_key(C.iso_year(d), C.iso_week(d)).cast("int").alias("week_key"),
                    C.day_text(d).alias("day_text"),
                    C.ts_text(F.col("o_orderdate")).alias("ts_text"))


@register("week_fallback_date")
def q_week_fallback_date(spark, sf_dir) -> DataFrame:
    """DT-5/DT-1/STR-11: date of a week number (base + (week-1) weeks), day-text parse, period label."""
    o = _t(spark, sf_dir).orders
    wk = C.iso_week(F.col("o_orderdate").cast("date"))
    fb = C.week_fallback_date(wk)
    txt = F.date_format(F.col("o_orderdate"), "d-M-yyyy")
    bad = F.when(F.col("o_orderkey") % 9 == 0, F.lit("31-02-2025")).otherwise(txt)
    return o.select("o_orderkey", wk.cast("int").alias("week"), fb.alias("fallback_day"),
                    C.parse_day(bad).alias("parsed_day"),
                    C.period_label(fb, F.date_add(fb, 6)).alias("period"))


# --------------------------------------------------------------------------- administration

LOG_TYPES, LOG_STATUSES = ["weekly"], []
DETAIL_WEEK, DETAIL_DAY = 100, date(1996, 12, 8)
SESSIONS_AS_OF, SESSION_LIFE_DAYS = "2024-01-25 00:00:00", 12


@register("company_counts")
def q_company_counts(spark, sf_dir) -> DataFrame:
    """JOIN-3/STR-11: sites and users per company, each side pre-aggregated."""
    t = _t(spark, sf_dir)
    return AD.company_counts(B.companies(t), B.sites(t), B.grants(t))


@register("site_counts")
def q_site_counts(spark, sf_dir) -> DataFrame:
    """JOIN-4: weeks with weekly data and days with daily data per site."""
    t = _t(spark, sf_dir)
    return AD.site_counts(B.sites(t).select("site_id", "name"), B.weekly(t), D.daily_table(t))


@register("user_companies")
def q_user_companies(spark, sf_dir) -> DataFrame:
    """JOIN-5/AGG-9/MAP-1: each user's companies as an ordered list."""
    t = _t(spark, sf_dir)
    return AD.user_companies(B.users(t), B.grants(t), B.companies(t))


@register("recent_logs")
def q_recent_logs(spark, sf_dir) -> DataFrame:
    """JOIN-6/SRT-4/FLT-8/MAP-1/DT-2: newest 100 loads with author and status symbol."""
    t = _t(spark, sf_dir)
    return AD.recent_logs(B.upload_logs(t), B.log_users(t), 100, LOG_TYPES, LOG_STATUSES)


@register("log_counters")
def q_log_counters(spark, sf_dir) -> DataFrame:
    """AGG-11: total / success / error loads per file type."""
    return AD.log_counters(B.upload_logs(_t(spark, sf_dir)))


@register("history_summary")
def q_history_summary(spark, sf_dir) -> DataFrame:
    """AGG-6: distinct weeks and sites, first and last day of the history."""
    return AD.history_summary(_hist(_t(spark, sf_dir)))


@register("weeks_available")
def q_weeks_available(spark, sf_dir) -> DataFrame:
    """AGG-7: per week the closing day, rows and sites; newest 100 weeks."""
    return AD.weeks_available(_hist(_t(spark, sf_dir)))


@register("week_detail")
def q_week_detail(spark, sf_dir) -> DataFrame:
    """FLT-6: history rows of one week."""
    h = HS.stored_history(spark, _t(spark, sf_dir), sf_dir).select("week", "day", "site", "margin", "weight")
    return AD.week_detail(h, week=DETAIL_WEEK)


@register("day_detail")
def q_day_detail(spark, sf_dir) -> DataFrame:
    """FLT-6, its first branch: history rows of one closing day (which has its week's partition)."""
    h = HS.stored_history(spark, _t(spark, sf_dir), sf_dir).select("week", "day", "site", "margin", "weight")
    return AD.week_detail(HS.since(h, DETAIL_DAY), week=DETAIL_WEEK, day=DETAIL_DAY)


@register("data_summary")
def q_data_summary(spark, sf_dir) -> DataFrame:
    """AGG-5/AGG-8/AGG-14: table counts, latest week key and latest day."""
    t = _t(spark, sf_dir)
    wk = B.weekly(t)
    dt = D.daily_table(t)
    counts = {"companies": B.companies(t), "sites": B.sites(t), "users": B.users(t), "weekly": wk,
              "daily": dt, "logs": B.upload_logs(t)}
    return AD.data_summary(counts, wk, dt)


@register("distinct_values")
def q_distinct_values(spark, sf_dir) -> DataFrame:
    """AGG-12/FLT-10: sorted distinct days, periods, sites, categories, concepts."""
    t = _t(spark, sf_dir)
    return AD.distinct_values(D.daily_table(t), B.weekly(t), B.sites(t))


# --------------------------------------------------------------------------- upserts, deletes, moves

MARGIN_DEFAULT_YEAR = 2025
RETENTION_AS_OF, RETENTION_DAYS = "2001-08-01", 90
CASCADE_COMPANY, PERIOD_RUN_WEEK = 3, 100
# A week that holds daily facts.
DAILY_PERIOD = ("2024-01-08", "2024-01-14")
STORED_AT, LOADED_AT = "2024-02-01 00:00:00", "2024-02-08 12:30:00"


@register("upsert_daily")
def q_upsert_daily(spark, sf_dir) -> DataFrame:
    """MRG-1/WIN-7: even event ids form the stored table, odd ones the incoming batch; on
    conflict only the value changes, the stored category stays; last write wins."""
    raw = B.daily(_t(spark, sf_dir))
    target = D.dedupe_daily(raw.filter(F.col("row_no") % 2 == 0)).drop("row_no")
    batch = raw.filter(F.col("row_no") % 2 == 1).withColumn("category", F.upper("category"))
    return MG.upsert(target, batch, D.DAILY_KEY, {"company_id": "keep", "category": "keep", "value": "new"},
                     order_col="row_no", partition_col="day")


@register("upsert_stamped")
def q_upsert_stamped(spark, sf_dir) -> DataFrame:
    """UPD-2 with MRG-1: rows that the upsert changes or inserts get the time of the load, all others keep theirs."""
    raw = B.daily(_t(spark, sf_dir))
    target = (D.dedupe_daily(raw.filter(F.col("row_no") % 2 == 0)).drop("row_no").withColumn("updated_at", F.lit(STORED_AT).cast("timestamp_ntz")))
    # Two of three loaded rows bring no value, so that some stored ones stay as they are.
    batch = raw.filter(F.col("row_no") % 2 == 1).withColumns({"value": F.when(F.col("row_no") % 3 == 0, F.col("value")), "updated_at": F.lit(None).cast("timestamp_ntz")})
    rules = {"company_id": "keep", "category": "keep", "value": "coalesce", "updated_at": "keep"}
    changed = MG.upsert(target, batch, D.DAILY_KEY, rules, order_col="row_no", partition_col="day", changed_col="changed")
    return MG.stamp_updated(changed, "changed", "updated_at", F.lit(LOADED_AT).cast("timestamp_ntz"))


def _weekly_part(t):
    return B.weekly(t).select("site_id", "year", "week", "run_week", "period_start", "period_end",
                              "margin", "fat", "prod", "weight")


@register("upsert_weekly_partial")
def q_upsert_weekly_partial(spark, sf_dir) -> DataFrame:
    """MRG-2: measures present (non-null) in the load overwrite, the others keep their value;
    period dates are always replaced."""
    w = _weekly_part(_t(spark, sf_dir))
    k = F.col("site_id") + F.col("run_week")
    target = w.filter(F.col("run_week") % 3 != 0)
    batch = w.filter(F.col("run_week") % 2 == 0).select(
        "site_id", "year", "week", F.lit(0).alias("ord"),
        F.date_add("period_start", 1).alias("period_start"), F.date_add("period_end", 1).alias("period_end"),
        F.when(k % 3 != 0, C.rnd(F.col("margin") * 1.1, 2)).alias("margin"),
        F.when(k % 4 != 0, F.col("fat") + 1).alias("fat"),
        F.lit(None).cast("double").alias("prod"), F.col("weight"))
    rules = {"period_start": "new", "period_end": "new", "margin": "coalesce", "fat": "coalesce",
             "prod": "coalesce", "weight": "coalesce"}
    return MG.upsert(target, batch, ["site_id", "year", "week"], rules, partition_col="year")


@register("upsert_history_full")
def q_upsert_history_full(spark, sf_dir) -> DataFrame:
    """MRG-3: history keyed by (week, site); every one of its measures replaced, nulls included. The rows of odd orders are
    stored, those of orders divisible by three are loaded over them."""
    report = H.history_report(_t(spark, sf_dir))
    k = F.col("row_no")
    return H.load_history(report.filter(k % 3 == 0), H.load_history(report.filter(k % 2 == 1)))


@register("upsert_margin")
def q_upsert_margin(spark, sf_dir) -> DataFrame:
    """MRG-4 + QLT-4: margin history upsert; rows without margin are rejected, a missing
    year takes the default year parameter."""
    w = B.weekly(_t(spark, sf_dir)).select("site_id", "company_id", "week", "year", "run_week", "margin", "weight")
    target = w.filter(F.col("run_week") % 2 == 1).drop("run_week")
    batch = (w.withColumn("year", F.when(F.col("run_week") % 10 != 0, F.col("year")))
              .withColumn("year", F.coalesce(F.col("year"), F.lit(MARGIN_DEFAULT_YEAR)))
              .filter(F.col("margin").isNotNull())
              .withColumn("margin", F.col("margin") + 1).drop("run_week"))
    return MG.upsert(target, batch, ["site_id", "week", "year"],
                     {"company_id": "keep", "margin": "new", "weight": "new"}, partition_col="year")


@register("upsert_config")
def q_upsert_config(spark, sf_dir) -> DataFrame:
    """MRG-5 + JSON-2: config values keyed by name with author; later writes win."""
    t = _t(spark, sf_dir)
    target = t.region.select(F.concat(F.lit("region."), F.col("r_name")).alias("key"),
                             C.to_json_value(F.col("r_regionkey").alias("id")).alias("value"),
                             F.lit("init").alias("updated_by"))
    r = t.region.select("r_regionkey", "r_name")
    n = t.nation.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    upd = n.select(F.concat(F.lit("region."), F.col("r_name")).alias("key"),
                   C.to_json_value(F.col("n_nationkey").alias("id")).alias("value"),
                   F.lit("admin").alias("updated_by"), F.col("n_nationkey").alias("ord"))
    new = n.select(F.concat(F.lit("nation."), F.col("n_name")).alias("key"),
                   C.to_json_value(F.col("n_nationkey").alias("id")).alias("value"),
                   F.lit("admin").alias("updated_by"), F.col("n_nationkey").alias("ord"))
    return MG.upsert(target, upd.unionByName(new), ["key"], {"value": "new", "updated_by": "new"}, order_col="ord")


@register("config_defaults")
def q_config_defaults(spark, sf_dir) -> DataFrame:
    """MRG-5, the do-nothing form: default values are inserted for keys that are absent, stored ones stay."""
    t = _t(spark, sf_dir)
    value = C.to_json_value(F.col("id")).alias("value")
    stored = t.region.select(F.concat(F.lit("region."), F.col("r_name")).alias("key"), F.col("r_regionkey").alias("id")).select("key", value, F.lit("init").alias("updated_by"))
    names = t.region.select(F.concat(F.lit("region."), F.col("r_name")).alias("key")).unionByName(t.nation.select(F.concat(F.lit("nation."), F.col("n_name")).alias("key")))
    return MG.insert_if_absent(stored, names.select("key", F.lit(-1).alias("id")).select("key", value, F.lit("default").alias("updated_by")), ["key"])


def _companies_existing(t):
    return t.nation.filter(F.col("n_nationkey") < 20).select(F.col("n_name").alias("code"),
                                                             F.col("n_nationkey").cast("long").alias("company_id"))


@register("load_dimensions")
def q_load_dimensions(spark, sf_dir) -> DataFrame:
    """MRG-6 + JOIN-7: insert companies whose code is absent, ids continue after max(id)."""
    t = _t(spark, sf_dir)
    return MG.get_or_create(_companies_existing(t), t.nation.select(F.col("n_name").alias("code")),
                            ["code"], "company_id")


@register("get_or_create_sites")
def q_get_or_create_sites(spark, sf_dir) -> DataFrame:
    """JOIN-7 + STR-6: sites keyed by (company, name); company from the code text before '_'."""
    t = _t(spark, sf_dir)
    s = t.supplier
    existing = s.filter(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_nationkey").alias("company_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("site_id"))
    code_raw = F.concat(F.col("s_nationkey").cast("string"), F.lit("_"), F.col("s_name"))
    incoming = s.select(C.company_code(code_raw).cast("int").alias("company_id"), F.col("s_name").alias("name"))
    return MG.get_or_create(existing, incoming, ["company_id", "name"], "site_id")


@register("first_site_per_company")
def q_first_site_per_company(spark, sf_dir) -> DataFrame:
    """JOIN-8: per normalised company name the site with the lowest id."""
    t = _t(spark, sf_dir)
    return ML.first_sites(B.sites(t), B.companies(t))


def _margin_load(spark, sf_dir) -> ML.MarginLoad:
    """The margin-history report of every weekly fact, loaded over the margins of odd running weeks."""
    t = _t(spark, sf_dir)
    w = materialize(B.weekly(t).select("site_id", "company_id", "year", "week", "run_week", "margin", "weight"), "margin-weeks")
    first = materialize(ML.first_sites(B.sites(t), B.companies(t)), "first-sites")
    stored = (w.join(first.select("site_id"), "site_id", "left_semi").filter(F.col("run_week") % 2 == 1)
              .select("site_id", F.col("week"), "year", "company_id", "margin", "weight"))
    return ML.load_margins(ML.margin_report(w, B.companies(t)), first, stored, MARGIN_DEFAULT_YEAR)


@register("margin_load")
def q_margin_load(spark, sf_dir) -> DataFrame:
    """MRG-4/JOIN-8: the margin history after the load of a margin report by company name."""
    return _margin_load(spark, sf_dir).table


@register("margin_load_rejects")
def q_margin_load_rejects(spark, sf_dir) -> DataFrame:
    """QLT-4/JOIN-12: the rows of the margin report that are not loaded: unknown company, no margin, unreadable values."""
    return _margin_load(spark, sf_dir).rejects


@register("margin_load_stats")
def q_margin_load_stats(spark, sf_dir) -> DataFrame:
    """QLT-6: rows processed, loaded and omitted, and distinct weeks, of the margin load."""
    return _margin_load(spark, sf_dir).stats


def _period_keys(t):
    return B.weekly(t).select("site_id", "year", "week", "run_week", "period_start", "period_end")


def _one_period() -> tuple[str, str]:
    import datetime as _dt
    start = _dt.date.fromisoformat(B.WEEK_EPOCH) + _dt.timedelta(days=7 * (PERIOD_RUN_WEEK - 1))
    return start.isoformat(), (start + _dt.timedelta(days=6)).isoformat()


def _without_latest_period(weekly, daily) -> tuple[DataFrame, DataFrame]:
    last = weekly.agg(F.max(F.struct("period_start", "period_end")).alias("p")).first()["p"]
    return MG.delete_period_facts(weekly, daily, *last) if last else (weekly, daily)


@register("delete_period")
def q_delete_period(spark, sf_dir) -> DataFrame:
    """DEL-1: remove the weekly rows of one period (its daily rows: ``delete_period_daily``)."""
    t = _t(spark, sf_dir)
    return MG.delete_period_facts(_period_keys(t), D.daily_table(t), *_one_period())[0].select("site_id", "year", "week")


def _daily_periods(t) -> DataFrame:
    """The weekly rows of the daily facts' calendar: two of three sites have one for each ISO week with facts."""
    monday = F.date_trunc("week", "day").cast("date")
    return (B.daily(t).filter(F.col("site_id") % 3 != 0).select("site_id", monday.alias("period_start")).distinct()
            .withColumn("period_end", F.date_add("period_start", 6)))


@register("delete_period_daily")
def q_delete_period_daily(spark, sf_dir) -> DataFrame:
    """DEL-1: the daily facts without those of the period's sites on its days."""
    t = _t(spark, sf_dir)
    return MG.delete_period_facts(_daily_periods(t), D.daily_table(t), *DAILY_PERIOD)[1].select("site_id", "day", "concept", "value")


@register("delete_latest_period")
def q_delete_latest_period(spark, sf_dir) -> DataFrame:
    """DEL-2: remove the newest period (max of (start, end)); its daily rows: ``delete_latest_period_daily``."""
    t = _t(spark, sf_dir)
    return _without_latest_period(_period_keys(t), D.daily_table(t))[0].select("site_id", "year", "week")


@register("delete_latest_period_daily")
def q_delete_latest_period_daily(spark, sf_dir) -> DataFrame:
    """DEL-2: the daily facts without those of the newest period's sites on its days."""
    t = _t(spark, sf_dir)
    return _without_latest_period(_daily_periods(t), D.daily_table(t))[1].select("site_id", "day", "concept", "value")


@register("cascade_delete")
def q_cascade_delete(spark, sf_dir) -> DataFrame:
    """DEL-3: delete one company from every fact; remaining row counts per table."""
    t = _t(spark, sf_dir)
    gone = spark.range(1).select(F.lit(CASCADE_COMPANY).cast("int").alias("company_id"))
    sites = B.sites(t)
    doomed_sites = sites.join(gone, "company_id").select("site_id", F.col("name").alias("site"))
    parts = {
        "sites": MG.delete_where(sites, gone, ["company_id"]),
        "weekly": MG.delete_where(B.weekly(t), gone, ["company_id"]),
        "daily": MG.delete_where(D.daily_table(t), gone, ["company_id"]),
        "history": MG.delete_where(_hist(t), doomed_sites, ["site"]),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _moves(t) -> DataFrame:
    return B.sites(t).filter(F.col("site_id") % 10 == 0).select(
        "site_id", ((F.col("company_id") + 1) % 25).alias("new_value"))


@register("move_site")
def q_move_site(spark, sf_dir) -> DataFrame:
    """UPD-1: every tenth site moves to the next company, in the facts (the dimension: ``move_site_dimension``)."""
    t = _t(spark, sf_dir)
    w = B.weekly(t).select("site_id", "year", "week", "company_id")
    return MG.move(w, _moves(t), "site_id", "company_id")


@register("move_site_dimension")
def q_move_site_dimension(spark, sf_dir) -> DataFrame:
    """UPD-1: every tenth site moves to the next company, in the dimension."""
    t = _t(spark, sf_dir)
    return MG.move(B.sites(t).select("site_id", "name", "company_id"), _moves(t), "site_id", "company_id")


@register("retention")
def q_retention(spark, sf_dir) -> DataFrame:
    """DEL-5: logs older than N days before the as-of date are removed; kept/removed counts."""
    logs = B.upload_logs(_t(spark, sf_dir))
    old = F.col("loaded_at") < F.date_sub(F.lit(RETENTION_AS_OF).cast("date"), RETENTION_DAYS)
    return logs.agg(F.count_if(old).cast("bigint").alias("removed"), F.count_if(~old).cast("bigint").alias("kept"))


# --------------------------------------------------------------------------- history report load


@register("history_load")
def q_history_load(spark, sf_dir) -> DataFrame:
    """QLT-8: the history table with all its measures after loading the history report (fuzzy headers,
    rejects, modal-date imputation, last write per (week, site))."""
    return H.load_history(H.history_report(_t(spark, sf_dir)))


@register("history_rejects")
def q_history_rejects(spark, sf_dir) -> DataFrame:
    """QLT-3: history report rows without week or site, with reasons."""
    return H.history_rejects(H.parse_history(H.history_report(_t(spark, sf_dir))))


# --------------------------------------------------------------------------- sessions and lock-outs (batch twins)

SESSION_GAPS = [60, 360]


@register("sessions")
def q_sessions(spark, sf_dir) -> DataFrame:
    """STM-2 batch twin: inactivity sessions per user for a 60-minute and a 6-hour gap."""
    e = _t(spark, sf_dir).events.select("user_id", "ts")
    seconds = slice_seconds(e)
    out = None
    for g in SESSION_GAPS:
        s = _sessions(e, g, seconds=seconds)
        out = s if out is None else out.unionByName(s)
    return out


@register("lockouts")
def q_lockouts(spark, sf_dir) -> DataFrame:
    """STM-3 batch twin: lock-outs after 5 failures, by composed functions of bounded chunks."""
    return _lockouts(_t(spark, sf_dir).events)


@register("report_matrix")
def q_report_matrix(spark, sf_dir) -> DataFrame:
    """RSH-8/AGG-1/DRV-6: matrix preview of the latest report week, from the report cells, with the history of the 52 weeks
    before it and the stored daily facts of concepts that the report lacks."""
    t = _t(spark, sf_dir)
    written = F.create_map(*[F.lit(x) for kv in R.REPORT_CONCEPTS for x in kv])
    daily = D.daily_table(t).select(F.concat(F.lit("Site "), F.col("site_id").cast("string")).alias("site"),
                                    C.clean_concept(F.element_at(written, F.col("concept"))).alias("concept"), "value").filter(F.col("concept").isNotNull())
    return R.report_matrix(materialize(R.tagged_cells(t), "tagged"), daily=daily)


@register("margin_rejects")
def q_margin_rejects(spark, sf_dir) -> DataFrame:
    """QLT-4/JOIN-12: margin-history rows rejected for an unknown site or an empty margin."""
    t = _t(spark, sf_dir)
    w = B.weekly(t).join(t.supplier.select(F.col("s_suppkey").alias("site_id"), F.col("s_name")), "site_id")
    name = F.when(F.col("site_id") % 9 == 0, F.concat(F.lit("Unknown "), F.col("s_name"))).otherwise(F.col("s_name"))
    incoming = w.select(name.alias("site"), "year", "week", "margin")
    known = B.sites(t).select(F.col("name").alias("site"))
    unknown = incoming.join(known, "site", "left_anti").withColumn("reason", F.lit("unknown site"))
    empty = (incoming.join(known, "site", "left_semi").filter(F.col("margin").isNull())
                     .withColumn("reason", F.lit("empty margin")))
    return unknown.unionByName(empty).select("site", "year", "week", "reason")


HISTORY_COMPANY, HISTORY_WEEKS_BACK = "nation_7", 52


@register("weeks_by_date")
def q_weeks_by_date(spark, sf_dir) -> DataFrame:
    """AGG-7 variant: history rows and sites per (week, closing day), all of them."""
    return AD.weeks_by_date(_hist(_t(spark, sf_dir)))


@register("history_by_date")
def q_history_by_date(spark, sf_dir) -> DataFrame:
    """SRC-9 + STR-10: one company's history from 52 weeks before the last closing day."""
    t = _t(spark, sf_dir)
    h = HS.stored_history(spark, t, sf_dir)
    latest = h.join(F.broadcast(h.agg(F.max("week").alias("week"))), "week").agg(F.max("day")).first()[0]  # one row
    if latest is None:
        return h.withColumn("company", F.lit(None).cast("string")).select("week", "day", "company", "site", "margin", "weight")
    start = latest - timedelta(days=7 * HISTORY_WEEKS_BACK)
    named = (HS.since(h, start).join(B.companies(t).select("company_id", F.col("name").alias("company")), "company_id")
             .select("week", "day", "company", "site", "margin", "weight"))
    return H.history_for_matrix(named, latest, HISTORY_WEEKS_BACK, company=HISTORY_COMPANY)


# --------------------------------------------------------------------------- sketches, collation, dimension load, readers


@register("history_sketches")
def q_history_sketches(spark, sf_dir) -> DataFrame:
    """AGG-6/AGG-13, approximate form: distinct sites per week from mergeable sketches, beside the exact counts; whether
    the estimates of all weeks lie within the sketch's bound, and whether merged weeks give what one pass gives."""
    return AD.distinct_by_sketch(_hist(_t(spark, sf_dir)), "week", "site")


@register("concept_by_collation")
def q_concept_by_collation(spark, sf_dir) -> DataFrame:
    """STR-4/STR-5/STR-10 by collation: concepts typed with other cases and composed or combining accents, to their keys."""
    t = _t(spark, sf_dir)
    from weekcraft.functions.concepts import CONCEPT_SPELLINGS, attach_by_collation
    spellings = F.array(*[F.lit(s) for s, _ in CONCEPT_SPELLINGS])
    k = F.col("p_partkey")
    base = F.trim(F.element_at(spellings, (k % len(CONCEPT_SPELLINGS) + 1).cast("int")))
    combining = base
    for plain, mark, composed in (("a", "\u0301", "á"), ("e", "\u0301", "é"), ("i", "\u0301", "í"), ("o", "\u0301", "ó"), ("n", "\u0303", "ñ")):
        combining = F.replace(combining, F.lit(composed), F.lit(plain + mark))
    typed = (F.when(k % 4 == 0, F.upper(base)).when(k % 4 == 1, combining).when(k % 4 == 2, F.translate(base, "aeiou", "âêîôû")).otherwise(F.concat(base, F.lit(" x"))))
    return attach_by_collation(t.part.select("p_partkey", typed.alias("concept")), "concept").select("p_partkey", "concept", "concept_key")


@register("load_dimension_sites")
def q_load_dimension_sites(spark, sf_dir) -> DataFrame:
    """MRG-6: sites by company code: the company's id is looked up, rows of unknown codes are passed over, absent sites are
    inserted with ids after the largest."""
    t = _t(spark, sf_dir)
    s = t.supplier
    existing = s.filter(F.col("s_suppkey") % 3 == 0).select(F.col("s_nationkey").alias("company_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("site_id"))
    code = F.when(F.col("s_suppkey") % 10 == 7, F.lit("nowhere")).otherwise(F.col("n_name"))
    incoming = s.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(code.alias("code"), F.col("s_name").alias("name"))
    return MG.load_sites(existing, incoming, B.companies(t).select("company_id", "code"))


@register("session_retention")
def q_session_retention(spark, sf_dir) -> DataFrame:
    """DEL-5: the sessions that stay: those expired, or inactive and older than seven days, are removed."""
    t = _t(spark, sf_dir)
    s = _sessions(t.events.select("user_id", "ts"), SESSION_GAPS[0]).withColumns(
        {"expires_at": F.col("session_end") + F.expr(f"INTERVAL {SESSION_LIFE_DAYS} DAYS"), "active": F.col("user_id") % 4 != 0})
    return AD.live_sessions(s, SESSIONS_AS_OF).select("user_id", "session_start", "session_end", "n_events", "active")


@register("history_report_clean")
def q_history_report_clean(spark, sf_dir) -> DataFrame:
    """SRC-2/SCH-6/STR-8: the persistent history report cleaned: margin column found, company as site, literal replacement,
    prefixes stripped, latest week first."""
    t = _t(spark, sf_dir)
    o = t.orders
    k = F.col("o_orderkey")
    site = (F.when(k % 5 == 0, F.lit("Ag. Los Maitenes")).when(k % 5 == 1, F.concat(F.lit("Fundo Site "), (F.col("o_custkey") % 40).cast("string")))
            .otherwise(F.concat(F.lit("Site "), (F.col("o_custkey") % 40).cast("string"))))
    report = o.select(k.alias("row_no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Fecha"),
                      F.when(k % 13 == 0, F.lit("x")).otherwise(F.weekofyear("o_orderdate").cast("string")).alias("N° Semana"), site.alias("Empresa"),
                      F.when(k % 7 != 0, C.fmt_es(F.col("o_totalprice") / 100)).alias("MDAT (I)"))
    return H.clean_history_report(report).select("row_no", "day", "week", "site", "margin")
