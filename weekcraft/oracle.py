"""Independent SQL (DuckDB dialect) for the driver's correctness gate.

Each query key of ``__spark_entry__.queries()`` has a SQL text here that computes the
same result directly from the pre-registered parquet views. The texts share CTE
fragments (the table bindings) but none of the Spark code.
"""

from __future__ import annotations

from weekcraft.functions.concepts import CONCEPT_SPELLINGS, MATRIX_FROM_KEY, WEEKLY_MEASURE_LABELS
from weekcraft.plans.matrix import TOTAL_LABEL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_(*ctes: tuple[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{b}\n)" for n, b in ctes) + "\n" + final


def rnd(expr: str) -> str:
    """round(x * 1e6) / 1e6 — the same double in both engines (no decimal-string ties)."""
    return f"(round(CAST({expr} AS DOUBLE) * 1000000.0) / 1000000.0)"


def r6(expr: str, alias: str) -> str:
    return f"{rnd(expr)} AS {alias}"


def snap(expr: str, d: int | None) -> str:
    if d is None:
        return expr
    f = f"{float(10 ** d)}"
    return f"(round(({expr}) * {f}) / {f})"


def dsum(x: str) -> str:
    """Exact sum: decimals add without rounding, in any order."""
    return f"CAST(sum(CAST({x} AS DECIMAL(28, 10))) AS DOUBLE)"


def davg(x: str) -> str:
    return f"CASE WHEN count({x}) > 0 THEN {dsum(x)} / count({x}) END"


def wa(v: str, w: str) -> str:
    """sum(v*w)/sum(w) over the rows that have both, w not 0."""
    ok = f"({v}) IS NOT NULL AND ({w}) IS NOT NULL AND ({w}) <> 0"
    den = dsum(f"CASE WHEN {ok} THEN {w} END")
    num = dsum(f"CASE WHEN {ok} THEN CAST({v} AS DOUBLE) * CAST({w} AS DOUBLE) END")
    return f"CASE WHEN {den} <> 0 THEN {num} / {den} END"


def fold(x: str) -> str:
    return f"replace(replace(strip_accents(lower({x})), '�', ''), '?', '')"


RUN_WEEK = "CAST(floor(datediff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7) + 1 AS INTEGER)"

WEEKLY_CTES = [
    ("li_c", f"""SELECT l_suppkey AS site_id, {RUN_WEEK} AS run_week, l_quantity,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc,
       CAST(round(l_tax * 100) AS BIGINT) AS tax
FROM lineitem"""),
    ("li_s", """SELECT site_id, run_week, count(*) AS n, sum(l_quantity) AS qty, sum(cents) AS ext_c,
       sum(cents * disc) AS cost_c, sum(tax) AS tax_p, sum(disc) AS disc_p
FROM li_c GROUP BY 1, 2"""),
    ("li_agg", """SELECT site_id, run_week, n, qty, qty / n AS prod0, ext_c / (qty * 100) AS price0,
       cost_c / (n * 10000) AS cost0, tax_p / (n * 100) AS tax0, disc_p / (n * 100) AS disc0,
       ext_c / (n * 100) AS ext0
FROM li_s"""),
    ("wb", """SELECT a.*, s.s_nationkey AS company_id, CAST(10 + s.s_suppkey % 37 AS DOUBLE) AS site_area,
       a.site_id + a.run_week AS k, DATE '1995-01-02' + CAST((a.run_week - 1) * 7 AS INTEGER) AS period_start
FROM li_agg a JOIN supplier s ON a.site_id = s.s_suppkey"""),
    ("wb2", """SELECT *, (round(CAST(prod0 AS DOUBLE) * 100.0) / 100.0) AS prod0_, (round(CAST(price0 AS DOUBLE) * 100.0) / 100.0) AS price_, (round(CAST(cost0 AS DOUBLE) * 100.0) / 100.0) AS cost_,
       CASE WHEN k % 11 <> 0 THEN site_area END AS area_,
       (round(CAST(tax0 * 50 + 4 AS DOUBLE) * 100.0) / 100.0) AS ms_conc_, (round(CAST(disc0 * 40 + 2 AS DOUBLE) * 100.0) / 100.0) AS ms_cons_
FROM wb"""),
    ("wb3", """SELECT *, CASE WHEN k % 13 <> 0 THEN prod0_ END AS prod_,
       CASE WHEN k % 7 <> 0 THEN (round(CAST(price_ * prod0_ - cost_ AS DOUBLE) * 100.0) / 100.0) END AS margin_,
       CASE WHEN k % 5 <> 0 THEN (round(CAST(prod0_ / 2 AS DOUBLE) * 100.0) / 100.0) ELSE 0.0 END AS greens_
FROM wb2"""),
    ("weekly", """SELECT site_id, company_id, CAST(isoyear(period_start) AS INTEGER) AS year,
       CAST(week(period_start) AS INTEGER) AS week, run_week, period_start, period_start + 6 AS period_end,
       area_ AS area, CAST(n * 50 AS BIGINT) AS herd, CAST(qty AS BIGINT) AS weight,
       (round(CAST(CASE WHEN area_ <> 0 THEN n * 50 / area_ END AS DOUBLE) * 100.0) / 100.0) AS stocking,
       (round(CAST(tax0 * 100 AS DOUBLE) * 100.0) / 100.0) AS fat, (round(CAST(disc0 * 10 + 3 AS DOUBLE) * 100.0) / 100.0) AS protein, (round(CAST(ext0 / 100 AS DOUBLE) * 100.0) / 100.0) AS conc_cost,
       CAST((n * 13 + site_id) % 150 + 250 AS INTEGER) AS grams_per_litre,
       ms_conc_ AS ms_conc, ms_cons_ AS ms_cons, greens_ AS greens, (round(CAST(greens_ + ms_conc_ + ms_cons_ AS DOUBLE) * 100.0) / 100.0) AS total_ms,
       prod_ AS prod, cost_ AS cost, price_ AS price,
       (round(CAST(CASE WHEN price_ <> 0 THEN margin_ / price_ END AS DOUBLE) * 100.0) / 100.0) AS margin_l,
       (round(CAST(CASE WHEN price_ * prod_ <> 0 THEN cost_ / (price_ * prod_) END AS DOUBLE) * 100.0) / 100.0) AS cost_pct,
       margin_ AS margin
FROM wb3"""),
]

HISTORY_CTE = ("hist", """SELECT w.run_week AS week, w.period_end AS day, s.s_name AS site, w.margin, w.weight,
       w.prod, w.price, w.cost, w.herd
FROM weekly w JOIN supplier s ON w.site_id = s.s_suppkey""")

DICT_CTES = [
    ("dict", "SELECT * FROM (VALUES " + ", ".join(f"({q(s)}, {q(k)})" for s, k in CONCEPT_SPELLINGS)
     + ") t(spelling, concept_key)"),
    ("dict_f", f"SELECT {fold('spelling')} AS folded, min(concept_key) AS k2 FROM dict GROUP BY 1"),
]


def long_ctes(week_filter: str | None = None) -> list[tuple[str, str]]:
    """SRC-5: latest week (or a filter), joined with dims, unpivoted by UNION ALL."""
    if week_filter is None:
        sel = [("latest", "SELECT year, week FROM weekly ORDER BY year DESC, week DESC LIMIT 1"),
               ("wk", "SELECT w.* FROM weekly w JOIN latest USING (year, week)")]
    else:
        sel = [("wk", f"SELECT * FROM weekly WHERE {week_filter}")]
    j = ("wj", """SELECT n.n_name AS company, n.n_name AS company_code, s.s_name AS site, wk.*
FROM wk JOIN supplier s ON wk.site_id = s.s_suppkey JOIN nation n ON wk.company_id = n.n_nationkey""")
    branches = []
    for m, label in WEEKLY_MEASURE_LABELS:
        cond = "" if m == "greens" else f" WHERE {m} IS NOT NULL"
        branches.append(f"SELECT company, company_code, site, week, {q(label)} AS concept, "
                        f"CAST({m} AS DOUBLE) AS total FROM wj{cond}")
    return sel + [j, ("long", "\nUNION ALL\n".join(branches))]


def matrix_ctes(long_name: str = "long", cells: bool = False, hist_cte=None, daily_cte=None) -> list[tuple[str, str]]:
    """daily_cte: CTE (site, concept_key, cell_sum, cell_cnt) that fills concepts without a row."""
    def metric(k):
        m = davg(f"CASE WHEN concept_key = {q(k)} THEN total END")
        if cells:
            cs = dsum(f"CASE WHEN concept_key = {q(k)} THEN cell_sum END")
            cc = f"sum(CASE WHEN concept_key = {q(k)} THEN cell_cnt END)"
            m = f"coalesce({m}, CASE WHEN {cc} <> 0 THEN {cs} / {cc} END)"
        return m
    piv = ", ".join(f"{metric(k)} AS {c}" for c, k in MATRIX_FROM_KEY)
    if cells:
        cs = dsum("CASE WHEN concept_key = 'mdat' THEN cell_sum END")
        cc = "sum(CASE WHEN concept_key = 'mdat' THEN cell_cnt END)"
        piv += f", CASE WHEN {cc} <> 0 THEN {cs} / {cc} END AS margin_cells"
    ml = ("CASE WHEN prod IS NOT NULL AND cost IS NOT NULL AND price IS NOT NULL AND price <> 0 "
          "THEN (price * prod - cost) / price END")
    if cells:
        ml = f"coalesce({ml}, margin_cells)"
    rows = ("piv", f"SELECT site, {piv} FROM keyed GROUP BY site")
    if daily_cte:
        kept = ", margin_cells" if cells else ""
        counts = ", ".join(f"count(CASE WHEN concept_key = {q(k)} THEN 1 END) AS n_{c}" for c, k in MATRIX_FROM_KEY)
        means = ", ".join(f"sum(CASE WHEN concept_key = {q(k)} THEN cell_sum END) / nullif(sum(CASE WHEN concept_key = {q(k)} THEN cell_cnt END), 0) AS d_{c}" for c, k in MATRIX_FROM_KEY)
        picked = ", ".join(f"CASE WHEN n_{c} = 0 THEN d_{c} ELSE {c} END AS {c}" for c, _ in MATRIX_FROM_KEY)
        rows = ("piv", f"""SELECT site, {picked}{kept} FROM (SELECT site, {piv}, {counts} FROM keyed GROUP BY site)
LEFT JOIN (SELECT site AS dsite, {means} FROM {daily_cte} GROUP BY site) ON site = dsite""")
    return DICT_CTES + [
        ("keyed", f"""SELECT l.*, coalesce(d.concept_key, f.k2) AS concept_key FROM {long_name} l
LEFT JOIN dict d ON l.concept = d.spelling LEFT JOIN dict_f f ON {fold('l.concept')} = f.folded"""),
        rows,
        ("d1", """SELECT *, CASE WHEN coalesce(greens_stored, 0) = 0 THEN coalesce(ms_pasture, 0) + coalesce(ms_green, 0)
                 ELSE greens_stored END AS greens FROM piv"""),
        ("d2", f"""SELECT *, greens + coalesce(ms_cons, 0) + coalesce(ms_conc, 0) AS total_ms,
       CASE WHEN area > 0 THEN herd / area END AS stocking,
       {ml} AS margin_l,
       CASE WHEN prod <> 0 AND price <> 0 AND cost <> 0 AND price * prod > 0 THEN cost / (price * prod) END AS cost_pct
FROM d1"""),
        hist_cte or HISTORY_CTE,
        ("hmx", "SELECT trim(site) AS site, week, margin, weight, max(week) OVER (PARTITION BY trim(site)) AS mx FROM hist"),
        ("hm", f"""SELECT site AS hsite,
       {davg('CASE WHEN week >= mx - 3 THEN margin END')} AS margin_4w,
       {davg('CASE WHEN week >= mx - 3 THEN weight END')} AS weight_4w,
       {davg('CASE WHEN week >= mx - 51 THEN margin END')} AS margin_52w,
       {davg('CASE WHEN week >= mx - 51 THEN weight END')} AS weight_52w
FROM hmx GROUP BY site"""),
        ("body0", "SELECT d2.*, hm.* EXCLUDE (hsite) FROM d2 LEFT JOIN hm ON trim(d2.site) = hm.hsite"),
        ("body", """SELECT *,
       CASE WHEN margin IS NOT NULL THEN rank() OVER (ORDER BY margin DESC NULLS LAST) END AS rank_margin,
       CASE WHEN margin_4w IS NOT NULL THEN rank() OVER (ORDER BY margin_4w DESC NULLS LAST) END AS rank_4w,
       CASE WHEN margin_52w IS NOT NULL THEN rank() OVER (ORDER BY margin_52w DESC NULLS LAST) END AS rank_52w
FROM body0"""),
        ("tot0", f"""SELECT coalesce({dsum('area')}, 0) AS area, coalesce({dsum('herd')}, 0) AS herd,
       coalesce({dsum('weight')}, 0) AS weight,
       {wa('fat', 'weight')} AS fat, {wa('protein', 'weight')} AS protein,
       {wa('conc_cost', 'weight')} AS conc_cost, {wa('grams_per_litre', 'weight * prod')} AS grams_per_litre,
       {wa('ms_conc', 'weight')} AS ms_conc, {wa('ms_cons', 'weight')} AS ms_cons,
       {wa('greens', 'weight')} AS greens, {wa('total_ms', 'weight')} AS total_ms,
       {wa('prod', 'weight')} AS prod, {wa('cost', 'weight')} AS cost, {wa('price', 'weight * prod')} AS price,
       {wa('margin', 'weight')} AS margin, {wa('margin_4w', 'weight')} AS margin_4w,
       coalesce(sum(weight_4w), 0) AS weight_4w, {wa('margin_52w', 'weight')} AS margin_52w,
       coalesce(sum(weight_52w), 0) AS weight_52w
FROM body"""),
        ("tot", f"""SELECT {q(TOTAL_LABEL)} AS site, *,
       CASE WHEN area > 0 THEN herd / area END AS stocking,
       CASE WHEN price <> 0 THEN margin / price END AS margin_l,
       CASE WHEN price <> 0 AND prod <> 0 AND price * prod > 0 THEN cost / (price * prod) END AS cost_pct,
       CAST(NULL AS BIGINT) AS rank_margin, CAST(NULL AS BIGINT) AS rank_4w, CAST(NULL AS BIGINT) AS rank_52w
FROM tot0"""),
    ]


MATRIX_OUT = ["site", "area", "herd", "weight", "stocking", "fat", "protein", "conc_cost", "grams_per_litre",
              "ms_conc", "ms_cons", "greens", "total_ms", "prod", "cost", "price", "margin_l", "cost_pct",
              "margin", "rank_margin", "margin_4w", "weight_4w", "rank_4w", "margin_52w", "weight_52w", "rank_52w"]


def matrix_select(src: str, is_total: bool) -> str:
    cols = []
    for c in MATRIX_OUT:
        if c == "site":
            cols.append("site")
        elif c.startswith("rank"):
            cols.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            cols.append(r6(c, c))
    return f"SELECT {', '.join(cols)}, {'TRUE' if is_total else 'FALSE'} AS is_total FROM {src}"


def weekly_matrix_sql(week_filter: str | None = None, site_filter: str | None = None) -> str:
    ctes = WEEKLY_CTES + long_ctes(week_filter)
    long_name = "long"
    if site_filter:
        ctes = ctes + [("long_sel", f"SELECT * FROM long WHERE {site_filter}")]
        long_name = "long_sel"
    ctes = ctes + matrix_ctes(long_name)
    final = matrix_select("body", False) + "\nUNION ALL\n" + matrix_select("tot", True)
    return with_(*ctes, final=final)
