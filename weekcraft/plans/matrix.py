"""Weekly site x metric matrix (RSH-7 and its parts: SRC-5, RSH-1, STR-5, AGG-1, RSH-6,
DRV-1..5, WIN-4, WIN-2, AGG-3, SCH-7, SET-2, SRT-1).

Plan shape: weekly (filtered to one week) ⋈ sites ⋈ companies → one ``unpivot`` →
dictionary join (30 rows, broadcast) → ONE ``groupBy(site)`` that computes every
concept's mean as a conditional aggregate (this is the pivot, without a second shuffle)
→ derived columns → left join of per-site trailing history → ranks → weighted total row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.functions.clean import strip_ws
from weekcraft.functions.concepts import (MATRIX_FROM_KEY, NULL_KEPT_MEASURE, WEEKLY_MEASURE_LABELS,
                                          attach_concept_key)
from weekcraft.operators import aggregates as A
from weekcraft.operators.rank import global_ranks
from weekcraft.operators.reshape import unpivot_measures
from weekcraft.operators.windows import trailing_actual
from weekcraft.sources import bindings as B
from weekcraft.sources.tables import Tables

# Fixed display label of the pinned total row.
TOTAL_LABEL = "Sumas y Promedios"

MATRIX_COLUMNS = [
    "site", "area", "herd", "weight", "stocking", "fat", "protein", "conc_cost", "grams_per_litre",
    "ms_conc", "ms_cons", "greens", "total_ms", "prod", "cost", "price", "margin_l", "cost_pct",
    "margin", "rank_margin", "margin_4w", "weight_4w", "rank_4w", "margin_52w", "weight_52w", "rank_52w",
]
RANK_COLUMNS = {"rank_margin": "margin", "rank_4w": "margin_4w", "rank_52w": "margin_52w"}
# DRV-8 flag columns: higher is better / lower is better.
HIGH_IS_GOOD = ["fat", "protein", "prod", "price", "margin", "margin_l", "margin_4w", "margin_52w"]
LOW_IS_GOOD = ["conc_cost", "grams_per_litre", "cost", "cost_pct", "rank_margin", "rank_4w", "rank_52w"]


def latest_week(weekly: DataFrame) -> DataFrame:
    """FLT-3: the latest (year, week) as a 1-row frame: ``max(struct(year, week))``."""
    return weekly.agg(F.max(F.struct("year", "week")).alias("_yw")).select(
        F.col("_yw.year").alias("year"), F.col("_yw.week").alias("week"))


def select_week(weekly: DataFrame, year: int | None = None, week: int | None = None) -> DataFrame:
    """Rows of one (year, week); the latest one when not given (FLT-3, FLT-4).

    A literal week is a plain predicate (pushed to the scan of a stored weekly table);
    the latest week is an equi-join with a 1-row frame (broadcast, bounded).
    """
    if year is not None and week is not None:
        return weekly.filter((F.col("year") == year) & (F.col("week") == week))
    return weekly.join(F.broadcast(latest_week(weekly)), ["year", "week"])


def weekly_of_week(t: Tables, year: int | None = None, week: int | None = None) -> DataFrame:
    """The weekly fact of one (year, week) — the latest when not given (FLT-3, FLT-4).

    The week becomes a ship-date range on the lineitem scan (``PushedFilters``), so only
    that week's rows are read and aggregated.
    """
    rw = B.latest_run_week(t) if year is None or week is None else B.run_week_of(year, week)
    return B.weekly(t, B.lineitem_for_weeks(t, rw, rw))


def weekly_long(t: Tables, weekly: DataFrame | None = None, year: int | None = None,
                week: int | None = None, one_week: bool = False) -> DataFrame:
    """SRC-5: the week's facts as (company, company_code, site, week, concept, total) rows.

    JOIN-1 + RSH-1: one scan and one ``Expand`` instead of 18 union branches; nulls dropped
    except for the greens label. With a stored ``weekly`` table the week is selected from
    it; otherwise the week is bound straight from the lineitem scan.
    """
    if weekly is None:
        wk = weekly_of_week(t, year, week)
    else:
        wk = weekly if one_week else select_week(weekly, year, week)
    s = B.sites(t).select("site_id", F.col("name").alias("site"))
    c = B.companies(t).select("company_id", F.col("name").alias("company"), F.col("code").alias("company_code"))
    joined = wk.join(s, "site_id").join(c, "company_id")
    keep = tuple(label for m, label in WEEKLY_MEASURE_LABELS if m == NULL_KEPT_MEASURE)
    return unpivot_measures(joined, ["company", "company_code", "site", "week"], WEEKLY_MEASURE_LABELS,
                            keep_null=keep)


def concept_metrics(long: DataFrame, site_col: str = "site", day_cols: list[str] | None = None,
                    daily_means: DataFrame | None = None) -> DataFrame:
    """AGG-1 fused with RSH-6: one row per site, one column per matrix input concept.

    metric = mean of non-null row totals, else mean of all non-null day cells of the
    concept's rows (when the long frame still carries day columns); without any row of the concept,
    the site's daily mean for it (``daily_means``: site, concept_key, cell_sum, cell_cnt).
    """
    keyed = attach_concept_key(long, "concept", "concept_key")
    day_cols = day_cols or []
    cells = bool(day_cols) or {"cell_sum", "cell_cnt"} <= set(long.columns)
    if day_cols:
        xs = [F.col(c).cast("double") for c in day_cols]
        keyed = keyed.withColumn("_cs", sum(F.coalesce(x, F.lit(0.0)) for x in xs)) \
                     .withColumn("_cc", sum(F.when(x.isNotNull(), 1).otherwise(0) for x in xs))
    elif cells:  # cell form: per-row sum / count of the parseable day cells
        keyed = keyed.withColumnsRenamed({"cell_sum": "_cs", "cell_cnt": "_cc"})

    def cell_mean(key):
        hit = f"concept_key = '{key}'"
        return f"try_divide({A.dec_sum_sql(f'CASE WHEN {hit} THEN _cs END')}, sum(CASE WHEN {hit} THEN _cc END))"
    aggs = []
    for col, key in MATRIX_FROM_KEY:
        m = A.dec_avg_sql(f"CASE WHEN concept_key = '{key}' THEN CAST(total AS DOUBLE) END")
        if cells:
            m = f"coalesce({m}, {cell_mean(key)})"
        aggs.append(F.expr(f"{m} AS {col}"))
    if cells:  # DRV-6: margin per litre falls back to the mean of the margin concept's day cells
        aggs.append(F.expr(f"{cell_mean('mdat')} AS _margin_cells"))
    if daily_means is not None:
        aggs += [F.expr(f"count(CASE WHEN concept_key = '{key}' THEN 1 END) AS _n_{col}") for col, key in MATRIX_FROM_KEY]
    out = keyed.groupBy(site_col).agg(*aggs)
    if daily_means is not None:
        dm = daily_means.groupBy(F.col(site_col).alias("_s")).agg(*[
            F.try_divide(F.sum(F.when(F.col("concept_key") == key, F.col("cell_sum"))),
                         F.sum(F.when(F.col("concept_key") == key, F.col("cell_cnt")))).alias(f"_d_{col}")
            for col, key in MATRIX_FROM_KEY])
        keep = [c for c in out.columns if c not in dict(MATRIX_FROM_KEY) and c != site_col and not c.startswith("_n_")]
        out = out.join(dm, F.col(site_col) == F.col("_s"), "left").select(
            site_col, *[F.when(F.col(f"_n_{col}") == 0, F.col(f"_d_{col}")).otherwise(F.col(col)).alias(col) for col, _ in MATRIX_FROM_KEY], *keep)
    return out


def derive(m: DataFrame) -> DataFrame:
    """DRV-1..5 on the pivoted rows (one projection; same rules as the Column helpers in
    ``operators.aggregates``)."""
    greens = ("CASE WHEN coalesce(greens_stored, 0.0D) = 0 THEN coalesce(ms_pasture, 0.0D) + coalesce(ms_green, 0.0D) "
              "ELSE coalesce(greens_stored, 0.0D) END")
    m = m.selectExpr("*", f"{greens} AS greens")
    out = m.selectExpr(
        "*",
        "greens + coalesce(ms_cons, 0.0D) + coalesce(ms_conc, 0.0D) AS total_ms",
        "CASE WHEN area > 0 THEN herd / area END AS stocking",
        "CASE WHEN prod IS NOT NULL AND cost IS NOT NULL AND price IS NOT NULL AND price != 0 "
        "THEN (price * prod - cost) / price END AS margin_l",
        "CASE WHEN prod IS NOT NULL AND prod != 0 AND price IS NOT NULL AND price != 0 AND cost IS NOT NULL "
        "AND cost != 0 AND price * prod > 0 THEN cost / (price * prod) END AS cost_pct")
    if "_margin_cells" in out.columns:
        out = out.withColumn("margin_l", F.coalesce("margin_l", "_margin_cells")).drop("_margin_cells")
    return out


def with_history(m: DataFrame, hist: DataFrame) -> DataFrame:
    """WIN-4 per site, joined by trimmed site name (JOIN-9)."""
    h = trailing_actual(hist.withColumn("site", strip_ws("site")), "site", "week")
    h = h.select(F.col("site").alias("_hs"),
                 F.col("margin_4w"), F.col("weight_4w"), F.col("margin_52w"), F.col("weight_52w"))
    return m.join(h, strip_ws("site") == F.col("_hs"), "left").drop("_hs")


def add_ranks(body: DataFrame) -> DataFrame:
    """WIN-2: rank desc, ties share the minimum, null stays null (two-phase, no single task)."""
    return global_ranks(body, [(v, r) for r, v in RANK_COLUMNS.items()], descending=True, keep_null=True)


def total_row(body: DataFrame, label: str = TOTAL_LABEL, group_cols: list[str] | None = None,
              history: bool = True) -> DataFrame:
    """AGG-3: one ``agg`` over the body (partial aggregation, no row shuffle), then ratios.

    With ``group_cols`` one total row per group (e.g. per week over the weekly fact).
    """
    def wa(v, by_litres=False):  # 2-decimal measures; weight is integral, weight*prod has 2 decimals
        if by_litres:
            return F.expr(f"{A.weighted_avg_sql(v, 'weight * prod')} AS {v}")
        return F.expr(f"{A.weighted_avg_sql(v, 'weight')} AS {v}")
    hist = [F.expr(f"{A.weighted_avg_sql('margin_4w', 'weight')} AS margin_4w"),
            F.expr(f"{A.sum0_sql('weight_4w')} AS weight_4w"),
            F.expr(f"{A.weighted_avg_sql('margin_52w', 'weight')} AS margin_52w"),
            F.expr(f"{A.sum0_sql('weight_52w')} AS weight_52w")]
    t = body.groupBy(*(group_cols or [])).agg(
        F.expr(f"{A.sum0_sql('area')} AS area"), F.expr(f"{A.sum0_sql('herd')} AS herd"),
        F.expr(f"{A.sum0_sql('weight')} AS weight"),
        wa("fat"), wa("protein"), wa("conc_cost"), wa("grams_per_litre", True), wa("ms_conc"), wa("ms_cons"),
        wa("greens"), wa("total_ms"), wa("prod"), wa("cost"), wa("price", True), wa("margin"),
        *(hist if history else []))
    return t.selectExpr(
        "*", f"'{label}' AS site",
        "CASE WHEN area > 0 THEN herd / area END AS stocking",
        "CASE WHEN price IS NOT NULL AND price != 0 THEN margin / price END AS margin_l",
        "CASE WHEN price IS NOT NULL AND price != 0 AND prod IS NOT NULL AND prod != 0 AND price * prod > 0 "
        "THEN cost / (price * prod) END AS cost_pct",
        "CAST(NULL AS BIGINT) AS rank_margin", "CAST(NULL AS BIGINT) AS rank_4w", "CAST(NULL AS BIGINT) AS rank_52w")


def finish(body: DataFrame, total: DataFrame, digits: int | None = 6) -> DataFrame:
    """SCH-7 + SET-2 + SRT-1: canonical column order, total row appended and sorted last."""
    def shape(df, is_total):
        cols = []
        for c in MATRIX_COLUMNS:
            if c == "site":
                cols.append(c)
            elif c.startswith("rank"):
                cols.append(f"CAST({c} AS BIGINT) AS {c}")
            elif digits is not None:
                f = f"{float(10 ** digits)}D"
                cols.append(f"round(CAST({c} AS DOUBLE) * {f}, 0) / {f} AS {c}")
            else:
                cols.append(f"CAST({c} AS DOUBLE) AS {c}")
        return df.selectExpr(*cols, f"{'true' if is_total else 'false'} AS is_total")
    return shape(body, False).unionByName(shape(total, True))


def sort_matrix(m: DataFrame, by: str = "margin", ascending: bool = False) -> DataFrame:
    """SRT-1: any column, nulls last both ways, total row pinned last."""
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return m.orderBy(F.col("is_total").asc(), key, F.col("site").asc())


def build_matrix(long: DataFrame, hist: DataFrame, materialize: bool = True,
                 daily_means: DataFrame | None = None, day_cols: list[str] | None = None) -> DataFrame:
    """RSH-7 ``build_matrix(long, history)``: body + ranks + weighted total row.

    The body feeds the rank statistics, the output and the total row, so it is written
    once to the shared checkpoint folder (one row per site) and read back.
    """
    body = with_history(derive(concept_metrics(long, day_cols=day_cols, daily_means=daily_means)), hist)
    if materialize:
        from weekcraft.session import materialize as _mat
        body = _mat(body, "matrix-body")
    body = add_ranks(body)
    return finish(body, total_row(body))


def matrix_inputs(t: Tables, year: int | None = None, week: int | None = None):
    """(long rows of the week, history) for the matrix.

    For the latest week every body site has data in that week, so its own anchor week
    (WIN-4) is the latest week and only weeks [latest-51, latest] can reach its 4/52-week
    means: the history is bound from that ship-date range (pushed to the scan) instead of
    all years, aggregated once and shared with the week's rows. For a past week, anchors
    may be later weeks, so the whole history is read.
    """
    if year is None or week is None:
        from weekcraft.session import materialize
        rw = B.latest_run_week(t)
        # one lineitem pass aggregates the 52 weeks; the small result (sites x 52 rows) is
        # written once and feeds both the matrix week and the history
        wk52 = materialize(B.weekly(t, B.lineitem_for_weeks(t, rw - 51, rw)), "weekly-52w")
        long = weekly_long(t, wk52.filter(F.col("run_week") == rw), one_week=True)
        return long, B.history(t, wk52)
    return weekly_long(t, None, year, week), B.history(t)


def weekly_matrix(t: Tables, year: int | None = None, week: int | None = None,
                  sites_filter: DataFrame | None = None) -> DataFrame:
    """Flagship: matrix of the latest (or given) week with history from all weeks.

    ``sites_filter`` (column ``site``) restricts the body BEFORE ranks and totals (FLT-1).
    The matrix week reads one week of lineitem (pushed ship-date range); for the latest
    week the history reads the trailing 52 weeks only (see below); the body is written once.
    """
    long, hist = matrix_inputs(t, year, week)
    if sites_filter is not None:
        long = long.join(sites_filter.select("site").distinct(), "site", "left_semi")
    return sort_matrix(build_matrix(long, hist))


# Per-column display kinds (FMT-4).
MONEY_COLUMNS = ["conc_cost", "cost", "price", "margin", "margin_4w", "margin_52w"]
PCT_COLUMNS = ["fat", "protein", "cost_pct"]
INT_COLUMNS = ["rank_margin", "rank_4w", "rank_52w", "herd", "weight", "weight_4w", "weight_52w", "grams_per_litre"]
FLOAT_COLUMNS = ["area", "stocking", "ms_conc", "ms_cons", "greens", "total_ms", "prod", "margin_l"]


def format_matrix(m: DataFrame) -> DataFrame:
    """FMT-3/FMT-4: every numeric matrix column as Spanish display text, one ``select``."""
    from weekcraft.functions.clean import format_columns
    kinds = {**{c: "money" for c in MONEY_COLUMNS}, **{c: "pct" for c in PCT_COLUMNS},
             **{c: "int" for c in INT_COLUMNS}, **{c: "float" for c in FLOAT_COLUMNS}}
    return format_columns(m, kinds)


def cell_flags(m: DataFrame) -> DataFrame:
    """DRV-8: per body cell 'good' / 'bad' / '' against the total row.

    The matrix is written once: its total row is fetched as scalars (bounded) and compared as
    literals, so the body is computed once and never joined or shuffled.
    """
    from weekcraft.session import materialize
    m = materialize(m, "matrix")
    tot = m.filter(F.col("is_total")).first()
    cols = [F.col("site")]
    for c in HIGH_IS_GOOD + LOW_IS_GOOD:
        avg = tot[c] if tot is not None else None
        v = F.col(c).cast("double")
        if avg is None:
            flag = F.lit("")
        else:
            better = v > F.lit(float(avg)) if c in HIGH_IS_GOOD else v < F.lit(float(avg))
            worse = v < F.lit(float(avg)) if c in HIGH_IS_GOOD else v > F.lit(float(avg))
            flag = F.when(v.isNull(), "").when(better, "good").when(worse, "bad").otherwise("")
        cols.append(flag.alias(f"{c}_flag"))
    return m.filter(~F.col("is_total")).select(*cols)


def weekly_matrix_selected(t: Tables, config: DataFrame) -> DataFrame:
    """FLT-1 + FLT-2 + SET-4 + JSON-1: configured sites ∩ available sites, else all.

    The configuration is a JSON text value (``{"min_area": n}``) parsed with a default.
    The selection is applied to the long rows, before ranks and totals.
    """
    from weekcraft.functions.clean import json_or_default
    default = F.struct(F.lit(0.0).alias("min_area"))
    row = (config.filter(F.col("key") == "matrix_selection")
                 .select(json_or_default("value", "min_area double", default).alias("c")).first())
    min_area = float(row["c"]["min_area"]) if row and row["c"]["min_area"] is not None else 0.0
    configured = B.sites(t).filter(F.col("area") >= min_area).select(F.col("name").alias("site"))
    long, hist = matrix_inputs(t)
    selected = long.select("site").distinct().join(configured, "site", "left_semi")
    if not selected.isEmpty():
        long = long.join(selected, "site", "left_semi")
    return sort_matrix(build_matrix(long, hist))


# SCH-8: two-level display headers (group -> columns).
HEADER_GROUPS = [
    ("site", ["site", "area", "herd", "weight", "stocking", "fat", "protein", "conc_cost", "grams_per_litre"]),
    ("dry_matter_per_cow", ["ms_conc", "ms_cons", "greens", "total_ms"]),
    ("economics", ["prod", "cost", "price", "margin_l", "cost_pct", "margin", "rank_margin"]),
    ("last_4_weeks", ["margin_4w", "weight_4w", "rank_4w"]),
    ("last_52_weeks", ["margin_52w", "weight_52w", "rank_52w"]),
]


def display_headers(m: DataFrame) -> DataFrame:
    """SCH-8: one struct column per header group, plus the total flag."""
    return m.select(*[F.struct(*cols).alias(g) for g, cols in HEADER_GROUPS], "is_total")


def sort_from_config(m: DataFrame, config: DataFrame, key: str = "matrix_sort") -> DataFrame:
    """SRT-2: default sort read from a JSON config value ``{"column": .., "direction": ..}``;
    a missing or unknown column falls back to the first matrix column."""
    from weekcraft.functions.clean import json_or_default
    default = F.struct(F.lit(MATRIX_COLUMNS[0]).alias("column"), F.lit("desc").alias("direction"))
    row = (config.filter(F.col("key") == key)
                 .select(json_or_default("value", "column string, direction string", default).alias("c")).first())
    col = row["c"]["column"] if row and row["c"]["column"] in m.columns else MATRIX_COLUMNS[0]
    asc = bool(row and (row["c"]["direction"] or "").lower() == "asc")
    return sort_matrix(m, col, ascending=asc)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """SRT-5: first ``n`` rows of an upload for a preview."""
    return df.limit(n)
