"""Logical model bound to the driver tables (no farm data exists there).

| logical   | built from            |
|-----------|-----------------------|
| companies | nation                |
| users     | region (one user per region), grants = nations of the region |
| sites     | supplier              |
| weekly    | lineitem aggregated by (supplier, running week), one pass |
| history   | weekly projected to (week, site name, margin, weight, ...) |
| daily     | events (site = user_id, day = date(ts), concept = event_type) |
| logs      | orders (+ customer)   |

The source tables hold no nulls, so nulls (and zeros) are injected by key arithmetic,
which an SQL oracle can reproduce exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.sources.tables import Tables

# Fixed binding parameters.
WEEK_EPOCH = "1995-01-02"  # a Monday; running week 1 starts here
AREA_BASE, AREA_MOD = 10, 37
HERD_PER_LINE = 50


def latest_run_week(t: Tables) -> int:
    """FLT-3 on the binding: the latest running week with data.

    Weeks increase with time, so the latest (year, week) of the weekly fact is the running
    week of the latest ship date: a one-column aggregate, resolved once as a parameter.
    """
    mx = t.lineitem.agg(F.max("l_shipdate").alias("m")).first()["m"]
    if mx is None:
        return 0
    import datetime as _dt
    epoch = _dt.date.fromisoformat(WEEK_EPOCH)
    return (mx.date() - epoch).days // 7 + 1


def run_week_of(year: int, week: int) -> int:
    """Running week of an ISO (year, week)."""
    import datetime as _dt
    monday = _dt.date.fromisocalendar(year, week, 1)
    return (monday - _dt.date.fromisoformat(WEEK_EPOCH)).days // 7 + 1


def lineitem_for_weeks(t: Tables, first: int, last: int) -> DataFrame:
    """Lineitem rows of running weeks [first, last] as a ship-date range (pushed to the scan)."""
    import datetime as _dt
    epoch = _dt.datetime.fromisoformat(WEEK_EPOCH)
    lo = epoch + _dt.timedelta(days=7 * (first - 1))
    hi = epoch + _dt.timedelta(days=7 * last)
    return t.lineitem.filter((F.col("l_shipdate") >= F.lit(lo).cast("timestamp_ntz"))
                             & (F.col("l_shipdate") < F.lit(hi).cast("timestamp_ntz")))


def companies(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("company_id"),
                           F.col("n_name").alias("code"),
                           F.col("n_name").alias("name"),
                           F.col("n_regionkey").alias("region_id"))


def sites(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("site_id"),
                             F.col("s_name").alias("name"),
                             F.col("s_nationkey").alias("company_id"),
                             (F.lit(AREA_BASE) + F.col("s_suppkey") % AREA_MOD).cast("double").alias("area"))


def users(t: Tables) -> DataFrame:
    """One user per region; users of region 3 are inactive (FLT-9 has something to drop)."""
    return t.region.select(F.col("r_regionkey").cast("bigint").alias("user_id"),
                           F.lower("r_name").alias("username"),
                           F.col("r_name").alias("full_name"),
                           (F.col("r_regionkey") != 3).alias("active"))


def grants(t: Tables) -> DataFrame:
    """(user, company) for every nation of the user's region."""
    return t.nation.select(F.col("n_regionkey").cast("bigint").alias("user_id"),
                           F.col("n_nationkey").alias("company_id"))


def weekly_raw(t: Tables, lineitem: DataFrame | None = None) -> DataFrame:
    """Per (site, running week) aggregate of lineitem: one scan, partial aggregation map-side.

    Money is summed in integer cents and rates in integer basis points, so every sum is
    exact and independent of partitioning and summation order; each measure is then one
    division. Results are identical on any cluster layout (and in any SQL engine).
    Expressions are SQL text (one JVM call per projection instead of one per operator).
    """
    li = lineitem if lineitem is not None else t.lineitem
    rw = f"CAST(floor(datediff(CAST(l_shipdate AS DATE), DATE'{WEEK_EPOCH}') / 7) + 1 AS INT)"
    a = (li.selectExpr("l_suppkey AS site_id", f"{rw} AS run_week", "l_quantity",
                       "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
                       "CAST(round(l_discount * 100) AS BIGINT) AS disc",
                       "CAST(round(l_tax * 100) AS BIGINT) AS tax")
           .groupBy("site_id", "run_week")
           .agg(F.expr("count(1) AS n"), F.expr("sum(l_quantity) AS qty"), F.expr("sum(cents) AS ext_c"),
                F.expr("sum(cents * disc) AS cost_c"), F.expr("sum(tax) AS tax_p"), F.expr("sum(disc) AS disc_p")))
    return a.selectExpr("site_id", "run_week", "n", "qty", "qty / n AS prod0", "ext_c / (qty * 100) AS price0",
                        "cost_c / (n * 10000) AS cost0", "tax_p / (n * 100) AS tax0", "disc_p / (n * 100) AS disc0",
                        "ext_c / (n * 100) AS ext0")


def _c2(x: str) -> str:
    """Stored like the reference's DECIMAL(p, 2) columns (NUM-4): round(x*100)/100."""
    return f"(round(CAST({x} AS DOUBLE) * 100.0, 0) / 100.0)"


def weekly(t: Tables, lineitem: DataFrame | None = None) -> DataFrame:
    """The weekly fact: key (site_id, year, week) with ISO year/week, plus run_week.

    The lineitem aggregate runs first; the supplier dimension is joined to the (much
    smaller) aggregate. AQE turns that join into a broadcast when the supplier side is
    measured small at run time and keeps a shuffle join otherwise.
    """
    a = weekly_raw(t, lineitem)
    s = t.supplier.selectExpr("s_suppkey AS site_id", "s_nationkey AS company_id",
                              f"CAST({AREA_BASE} + s_suppkey % {AREA_MOD} AS DOUBLE) AS site_area")
    base = a.join(s, "site_id").selectExpr(
        "*", "site_id + run_week AS k", f"date_add(DATE'{WEEK_EPOCH}', (run_week - 1) * 7) AS period_start",
        f"{_c2('prod0')} AS prod0_", f"{_c2('price0')} AS price_", f"{_c2('cost0')} AS cost_",
        f"{_c2('tax0 * 50 + 4')} AS ms_conc_", f"{_c2('disc0 * 40 + 2')} AS ms_cons_")
    base = base.selectExpr(
        "*", "CASE WHEN k % 13 != 0 THEN prod0_ END AS prod_", "CASE WHEN k % 11 != 0 THEN site_area END AS area_",
        f"CASE WHEN k % 7 != 0 THEN {_c2('price_ * prod0_ - cost_')} END AS margin_",
        f"CASE WHEN k % 5 != 0 THEN {_c2('prod0_ / 2')} ELSE 0.0D END AS greens_")
    return base.selectExpr(
        "site_id", "company_id",
        "CAST(extract(YEAROFWEEK FROM period_start) AS INT) AS year",
        "CAST(weekofyear(period_start) AS INT) AS week",
        "run_week", "period_start", "date_add(period_start, 6) AS period_end",
        "area_ AS area", f"CAST(n * {HERD_PER_LINE} AS BIGINT) AS herd", "CAST(qty AS BIGINT) AS weight",
        f"{_c2(f'try_divide(n * {HERD_PER_LINE}, area_)')} AS stocking",
        f"{_c2('tax0 * 100')} AS fat", f"{_c2('disc0 * 10 + 3')} AS protein", f"{_c2('ext0 / 100')} AS conc_cost",
        "CAST((n * 13 + site_id) % 150 + 250 AS INT) AS grams_per_litre",
        "ms_conc_ AS ms_conc", "ms_cons_ AS ms_cons", "greens_ AS greens",
        f"{_c2('greens_ + ms_conc_ + ms_cons_')} AS total_ms",
        "prod_ AS prod", "cost_ AS cost", "price_ AS price",
        f"{_c2('try_divide(margin_, price_)')} AS margin_l",
        f"{_c2('try_divide(cost_, price_ * prod_)')} AS cost_pct",
        "margin_ AS margin")


def history(t: Tables, wk: DataFrame | None = None) -> DataFrame:
    """Running history keyed by (week, site name): week is the running week, no year."""
    w = wk if wk is not None else weekly(t)
    s = sites(t).select("site_id", F.col("name").alias("site"))
    return (w.join(s, "site_id")
             .select(F.col("run_week").alias("week"), F.col("period_end").alias("day"), "site",
                     "margin", "weight", "prod", "price", "cost", "herd"))


def daily(t: Tables) -> DataFrame:
    """Daily facts (site_id, day, concept) with repeated keys; row_no orders the writes."""
    e = t.events
    cat = (F.when(F.col("event_type").isin("click", "view"), F.lit("activity"))
            .when(F.col("event_type") == "purchase", F.lit("sales"))
            .otherwise(F.lit("account")))
    return e.select(F.col("user_id").alias("site_id"),
                    (F.col("user_id") % 25).cast("int").alias("company_id"),
                    F.col("ts").cast("date").alias("day"),
                    cat.alias("category"),
                    F.col("event_type").alias("concept"),
                    F.col("value"),
                    F.col("event_id").alias("row_no"))




def upload_logs(t: Tables) -> DataFrame:
    o = t.orders
    status = (F.when(F.col("o_orderkey") % 50 == 0, "pending")
               .when(F.col("o_orderstatus") == "F", "exito")
               .when(F.col("o_orderstatus") == "O", "error")
               .otherwise("warning"))
    return o.select(F.col("o_orderkey").alias("log_id"),
                    F.col("o_custkey").alias("user_id"),
                    F.when(F.col("o_orderkey") % 2 == 0, "weekly").otherwise("history").alias("file_type"),
                    F.concat(F.lit("report_"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("file_name"),
                    F.col("o_orderdate").alias("loaded_at"),
                    (F.col("o_orderkey") % 97).cast("int").alias("processed"),
                    (F.col("o_orderkey") % 5).cast("int").alias("omitted"),
                    status.alias("status"),
                    F.col("o_orderpriority").alias("message"))


def log_users(t: Tables) -> DataFrame:
    """Log authors: customers (JOIN-6); users with custkey % 10 = 0 are inactive."""
    return t.customer.select(F.col("c_custkey").alias("user_id"),
                             F.col("c_name").alias("username"),
                             (F.col("c_custkey") % 10 != 0).alias("active"))
