"""Oracle SQL per registered query key (DuckDB dialect, pre-registered parquet views)."""

from __future__ import annotations

from weekcraft.oracle import WEEKLY_CTES, long_ctes, r6, weekly_matrix_sql, with_
from weekcraft.functions.concepts import CONCEPT_SPELLINGS, WEEKLY_MEASURE_LABELS
from weekcraft.oracle import DICT_CTES, HISTORY_CTE, MATRIX_OUT, davg, dsum, fold, matrix_ctes, q, snap, wa
from weekcraft.plans.matrix import (FLOAT_COLUMNS, HIGH_IS_GOOD, INT_COLUMNS, LOW_IS_GOOD, MONEY_COLUMNS,
                                    PCT_COLUMNS)
from weekcraft.plans.catalog import DETAIL_CATEGORIES, DETAIL_DAYS, DETAIL_USER, SECURED_USER
from weekcraft.plans.report import REPORT_CONCEPTS, REPORT_VARIANTS, WEEKLY_PATTERNS, WEEKLY_TARGETS
from weekcraft.plans.admin import STATUS_DEFAULT, STATUS_SYMBOLS
from weekcraft.plans.catalog import DETAIL_DAY, DETAIL_WEEK, SESSION_LIFE_DAYS, SESSIONS_AS_OF
from weekcraft.plans.catalog import (CASCADE_COMPANY, MARGIN_DEFAULT_YEAR, PERIOD_RUN_WEEK,
                                     RETENTION_AS_OF, RETENTION_DAYS, DAILY_PERIOD, LOADED_AT, STORED_AT)
from weekcraft.plans.history import HISTORY_MEASURES, REASON_NO_SITE, REASON_NO_WEEK, REPORT_MEASURES
from weekcraft.plans.catalog import KNOWN_COMPANIES, SESSION_GAPS, STORED_WEEKS
from weekcraft.plans.weekly_load import MEASURES as LOAD_MEASURES
from weekcraft.oracle import matrix_select
from weekcraft.plans.catalog import HISTORY_COMPANY, HISTORY_WEEKS_BACK
from weekcraft.streaming.lockouts import BLOCK_MINUTES, MAX_FAILURES

ORACLE: dict[str, str] = {}

ORACLE["weekly_matrix"] = weekly_matrix_sql()

ORACLE["weekly_long"] = with_(*WEEKLY_CTES, *long_ctes(), final=f"""
SELECT company, company_code, site, CAST(week AS INTEGER) AS week, concept, {r6('total', 'total')} FROM long""")


W = WEEKLY_CTES

ORACLE["weighted_totals"] = with_(*W, ("t0", f"""SELECT year, week,
       coalesce({dsum('area')}, 0) AS area, coalesce({dsum('herd')}, 0) AS herd, coalesce({dsum('weight')}, 0) AS weight,
       {wa('fat', 'weight')} AS fat, {wa('protein', 'weight')} AS protein,
       {wa('conc_cost', 'weight')} AS conc_cost, {wa('grams_per_litre', 'weight * prod')} AS grams_per_litre,
       {wa('ms_conc', 'weight')} AS ms_conc, {wa('ms_cons', 'weight')} AS ms_cons,
       {wa('greens', 'weight')} AS greens, {wa('total_ms', 'weight')} AS total_ms,
       {wa('prod', 'weight')} AS prod, {wa('cost', 'weight')} AS cost, {wa('price', 'weight * prod')} AS price,
       {wa('margin', 'weight')} AS margin
FROM weekly GROUP BY year, week"""), final=f"""
SELECT year, week, {', '.join(r6(c, c) for c in ['area', 'herd', 'weight', 'fat', 'protein', 'conc_cost',
    'grams_per_litre', 'ms_conc', 'ms_cons', 'greens', 'total_ms', 'prod', 'cost', 'price', 'margin'])},
       {r6('CASE WHEN area > 0 THEN herd / area END', 'stocking')},
       {r6('CASE WHEN price <> 0 THEN margin / price END', 'margin_l')},
       {r6('CASE WHEN price <> 0 AND prod <> 0 AND price * prod > 0 THEN cost / (price * prod) END', 'cost_pct')}
FROM t0""")

_GF = "CASE WHEN coalesce(greens, 0) = 0 THEN coalesce(pasture, 0) + coalesce(green, 0) ELSE greens END"
ORACLE["derived_metrics"] = with_(*W, ("d", """SELECT *, CASE WHEN run_week % 3 <> 0 THEN ms_cons / 2 END AS pasture,
       CASE WHEN run_week % 4 <> 0 THEN ms_conc / 4 END AS green FROM weekly"""), final=f"""
SELECT site_id, run_week, {r6(_GF, 'greens_fixed')},
       {r6(f'({_GF}) + coalesce(ms_cons, 0) + coalesce(ms_conc, 0)', 'total_ms_calc')},
       {r6('price * prod - cost', 'margin_calc')},
       {r6('CASE WHEN prod IS NOT NULL AND cost IS NOT NULL AND price <> 0 THEN (price * prod - cost) / price END', 'margin_l')},
       {r6('CASE WHEN area > 0 THEN herd / area END', 'stocking')},
       {r6('CASE WHEN prod <> 0 AND price <> 0 AND cost <> 0 AND price * prod > 0 THEN cost / (price * prod) END', 'cost_pct')},
       {r6('CASE WHEN pasture IS NOT NULL OR green IS NOT NULL THEN coalesce(pasture, 0) + coalesce(green, 0) END', 'greens_weekly')}
FROM d""")

ORACLE["trailing_actual"] = with_(*W, HISTORY_CTE, ("hx", "SELECT *, max(week) OVER (PARTITION BY site) AS mx FROM hist"),
                                  final=f"""
SELECT site, max(mx) AS last_week,
       {r6(davg('CASE WHEN week >= mx - 3 THEN margin END'), 'margin_4w')},
       {r6(davg('CASE WHEN week >= mx - 3 THEN weight END'), 'weight_4w')},
       {r6(davg('CASE WHEN week >= mx - 51 THEN margin END'), 'margin_52w')},
       {r6(davg('CASE WHEN week >= mx - 51 THEN weight END'), 'weight_52w')}
FROM hx GROUP BY site""")


def _fixed(c, n):
    """Written from the rule, not as a window: the last n rows of earlier days."""
    last = f"(SELECT {c} FROM hist p WHERE p.site = h.site AND p.day < h.day ORDER BY p.day DESC, p.week DESC LIMIT {n})"
    return r6(f"(SELECT CASE WHEN count(*) > 0 THEN coalesce({snap(f'sum({c})', 2)}, 0) / {n} END FROM {last})", f"{c}_{n}f")


ORACLE["trailing_fixed"] = with_(*W, HISTORY_CTE, final=f"""
SELECT site, week, day, {r6('margin', 'margin')}, weight,
       {_fixed('margin', 4)}, {_fixed('weight', 4)}, {_fixed('margin', 52)}, {_fixed('weight', 52)}
FROM hist h""")


def _roll(c, n):
    w = f"(PARTITION BY site ORDER BY week RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return r6(f"CASE WHEN count({c}) OVER {w} > 0 THEN {snap(f'sum(CAST({c} AS DOUBLE)) OVER {w}', 2)} / count({c}) OVER {w} END",
              f"{c}_{n}w")


ORACLE["trailing_series"] = with_(*W, HISTORY_CTE, final=f"""
SELECT site, week, {r6('margin', 'margin')}, weight, {_roll('margin', 4)}, {_roll('weight', 4)},
       {_roll('margin', 52)}, {_roll('weight', 52)}
FROM hist""")

ORACLE["history_window"] = with_(*W, HISTORY_CTE, ("cw", "SELECT max(week) AS cw FROM hist"), final=f"""
SELECT h.week, h.day, h.site, n.n_name AS company, {r6('h.margin', 'margin')}, {r6('h.weight', 'weight')}
FROM hist h JOIN cw ON h.week < cw.cw AND h.week >= cw.cw - 52
JOIN supplier s ON trim(s.s_name) = trim(h.site) JOIN nation n ON s.s_nationkey = n.n_nationkey""")

_WN = ("wn", """SELECT w.site_id, s.s_name AS site, w.company_id, w.year, w.week, w.margin
FROM weekly w JOIN supplier s ON w.site_id = s.s_suppkey""")
ORACLE["rank_all_weeks"] = with_(*W, _WN, final=f"""
SELECT site_id, site, company_id, year, week, {r6('margin', 'margin')},
       CAST(rank() OVER (ORDER BY margin DESC NULLS LAST) AS BIGINT) AS rank FROM wn""")
ORACLE["rank_nulls_kept"] = with_(*W, _WN, final=f"""
SELECT site_id, site, company_id, year, week, {r6('margin', 'margin')},
       CAST(CASE WHEN margin IS NOT NULL THEN rank() OVER (ORDER BY margin DESC NULLS LAST) END AS BIGINT) AS rank FROM wn""")
ORACLE["rank_per_week"] = with_(*W, _WN, final=f"""
SELECT site_id, site, company_id, year, week, {r6('margin', 'margin')},
       CAST(rank() OVER (PARTITION BY year, week ORDER BY margin DESC NULLS LAST) AS BIGINT) AS rank FROM wn""")

_branches = []
for _m, _label in WEEKLY_MEASURE_LABELS:
    _cond = "" if _m == "greens" else f" WHERE {_m} IS NOT NULL"
    _branches.append(f"SELECT site, run_week, {q(_label)} AS concept, CAST({_m} AS DOUBLE) AS total FROM wn2{_cond}")


def clean_concept_sql(x: str) -> str:
    inner = f"regexp_replace(trim({x}), '^\\([A-Za-z0-9]+\\)\\s*', '')"
    return f"nullif(trim(regexp_replace({inner}, ' {{2,}}', ' ', 'g')), '')"


ORACLE["concept_metric"] = with_(
    *W, ("wn2", "SELECT w.*, s.s_name AS site FROM weekly w JOIN supplier s ON w.site_id = s.s_suppkey"),
    ("long_all", "\nUNION ALL\n".join(_branches)),
    ("dirty", """SELECT site, run_week, total, CASE run_week % 4 WHEN 0 THEN concept WHEN 1 THEN upper(concept)
       WHEN 2 THEN strip_accents(concept) ELSE '(A)  ' || concept || ' ' END AS raw FROM long_all"""),
    ("cleaned", f"SELECT site, run_week, total, {clean_concept_sql('raw')} AS concept FROM dirty"),
    *DICT_CTES,
    ("keyed", f"""SELECT c.*, coalesce(d.concept_key, f.k2) AS concept_key FROM cleaned c
LEFT JOIN dict d ON c.concept = d.spelling LEFT JOIN dict_f f ON {fold('c.concept')} = f.folded"""),
    final=f"SELECT site, concept_key, {r6(davg('total'), 'metric')}, count(*) AS n FROM keyed GROUP BY site, concept_key")


def _matrix_rounded_ctes(site_filter=None):
    ctes = W + long_ctes()
    long_name = "long"
    if site_filter:
        ctes = ctes + [("long_sel", f"SELECT * FROM long WHERE {site_filter}")]
        long_name = "long_sel"
    ctes = ctes + matrix_ctes(long_name)

    def sel(src):
        cols = ["site"] + [f"CAST({c} AS BIGINT) AS {c}" if c.startswith("rank") else r6(c, c) for c in MATRIX_OUT[1:]]
        return f"SELECT {', '.join(cols)} FROM {src}"
    return ctes + [("rb", sel("body")), ("rt", sel("tot"))]


def _flag(c):
    hi = c in HIGH_IS_GOOD
    better, worse = (">", "<") if hi else ("<", ">")
    return (f"CASE WHEN rt.{c} IS NULL OR rb.{c} IS NULL THEN '' WHEN rb.{c} {better} rt.{c} THEN 'good' "
            f"WHEN rb.{c} {worse} rt.{c} THEN 'bad' ELSE '' END AS {c}_flag")


ORACLE["cell_flags"] = with_(*_matrix_rounded_ctes(), final=f"""
SELECT rb.site, {', '.join(_flag(c) for c in HIGH_IS_GOOD + LOW_IS_GOOD)} FROM rb CROSS JOIN rt""")


def fmt_es_sql(x):
    return f"coalesce(translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,'), '')"


def fmt_sql(c):
    if c in MONEY_COLUMNS:
        return f"CASE WHEN {c} IS NULL THEN '' ELSE '$' || {fmt_es_sql(c)} END AS {c}"
    if c in PCT_COLUMNS:
        return f"CASE WHEN {c} IS NULL THEN '' ELSE {fmt_es_sql(c)} || '%' END AS {c}"
    if c in INT_COLUMNS:
        return f"coalesce(CAST(CAST(trunc(CAST({c} AS DOUBLE)) AS BIGINT) AS VARCHAR), '') AS {c}"
    if c in FLOAT_COLUMNS:
        return f"{fmt_es_sql(c)} AS {c}"
    return c


ORACLE["format_matrix"] = with_(*_matrix_rounded_ctes(), (
    "m", "SELECT *, FALSE AS is_total FROM rb UNION ALL SELECT *, TRUE AS is_total FROM rt"),
    final=f"SELECT {', '.join(fmt_sql(c) for c in MATRIX_OUT)}, is_total FROM m")

_CFG = "SELECT s_name AS site FROM supplier WHERE 10 + s_suppkey % 37 >= 30"
ORACLE["weekly_matrix_selected"] = weekly_matrix_sql(
    site_filter=f"site IN ({_CFG}) OR (SELECT count(*) FROM long WHERE site IN ({_CFG})) = 0")

# --------------------------------------------------------------------------- daily facts and reports

DAILY_CTES = [
    ("ev", """SELECT user_id AS site_id, CAST(user_id % 25 AS INTEGER) AS company_id, CAST(ts AS DATE) AS day,
       CASE WHEN event_type IN ('click', 'view') THEN 'activity' WHEN event_type = 'purchase' THEN 'sales'
            ELSE 'account' END AS category, event_type AS concept, value, event_id AS row_no
FROM events"""),
    ("dt", """SELECT site_id, day, concept, min_by(company_id, row_no) AS company_id, min_by(category, row_no) AS category,
       max_by(value, row_no) AS value, max(row_no) AS row_no
FROM ev GROUP BY site_id, day, concept"""),
]
DAY_TEXT = "strftime(day, '%d-%m-%Y')"

def _day_cells(value: str, gap: str) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN day = DATE '{d}' THEN {value} END), {gap}) AS \"{d:%d-%m-%Y}\"" for d in DETAIL_DAYS)


_in_period = f"day BETWEEN DATE '{DETAIL_DAYS[0]}' AND DATE '{DETAIL_DAYS[-1]}'"
ORACLE["daily_pivot"] = with_(*DAILY_CTES, final=f"""
SELECT site_id, category, concept, {_day_cells('value', 'NULL')}, coalesce({dsum('value')}, 0) AS total
FROM dt WHERE {_in_period} GROUP BY site_id, category, concept""")

_cats = ", ".join(q(c) for c in DETAIL_CATEGORIES)
ORACLE["daily_detail"] = with_(*DAILY_CTES, final=f"""
SELECT s.s_name AS site, category, concept, {_day_cells('value', '0.0')}, coalesce({dsum('value')}, 0) AS total
FROM dt JOIN supplier s ON dt.site_id = s.s_suppkey
WHERE company_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = {DETAIL_USER}) AND category IN ({_cats}) AND {_in_period}
GROUP BY s.s_name, category, concept""")

ORACLE["secured_daily"] = with_(*DAILY_CTES, final=f"""
SELECT n.n_name AS company, s.s_name AS site, dt.day, dt.category, dt.concept, dt.value
FROM dt JOIN supplier s ON dt.site_id = s.s_suppkey JOIN nation n ON dt.company_id = n.n_nationkey
WHERE n.n_regionkey = {SECURED_USER}""")

ORACLE["visible_sites"] = """
SELECT CAST(n.n_regionkey AS BIGINT) AS user_id, s.s_suppkey AS site_id, s.s_name AS name, s.s_nationkey AS company_id
FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey <> 3"""

NUMBER_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean_number_sql(x: str) -> str:
    t = f"replace(replace(replace(trim({x}), '$', ''), '%', ''), ' ', '')"
    t2 = (f"(CASE WHEN contains({t}, '.') AND contains({t}, ',') THEN replace(replace({t}, '.', ''), ',', '.') "
          f"WHEN contains({t}, ',') THEN replace({t}, ',', '.') ELSE {t} END)")
    return f"(CASE WHEN regexp_matches({t2}, '{NUMBER_RE}') THEN TRY_CAST({t2} AS DOUBLE) END)"


def clean_site_sql(x: str) -> str:
    import re as _re
    from weekcraft.functions.clean import SITE_PREFIXES
    e = f"trim({x})"
    for p in SITE_PREFIXES:
        e = f"trim(regexp_replace({e}, '(?i)^{_re.escape(p)} ', ''))"
    return e


_concept_case = "CASE concept " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in REPORT_CONCEPTS) + " END"
_variants = " ".join(f"WHEN site_id % 5 = {r} AND concept = {q(c)} THEN {q(w)}" for r, c, w in REPORT_VARIANTS)
REPORT_CTES = DAILY_CTES + [
    ("rc0", """SELECT dt.*, n.n_name AS company, CAST(isoyear(day) AS INTEGER) AS year, CAST(week(day) AS INTEGER) AS week,
       CASE WHEN site_id % 7 = 0 THEN dayofmonth(day) % 2 ELSE 0 END AS report_row
FROM dt JOIN nation n ON dt.company_id = n.n_nationkey"""),
    ("rc1", """SELECT *, CASE WHEN count(value) OVER w > 0 THEN (round(sum(value) OVER w * 100.0) / 100.0) / count(value) OVER w
       END AS mean FROM rc0 WINDOW w AS (PARTITION BY site_id, year, week, concept, report_row)"""),
    ("rc", f"""SELECT company, CAST(company_id AS VARCHAR) || '_' || company AS company_code_raw,
       CASE site_id % 3 WHEN 0 THEN 'Fundo Site ' || site_id WHEN 1 THEN 'Agricola Site ' || site_id
            ELSE ' Site ' || site_id || ' ' END AS site_raw, category,
       CASE WHEN site_id % 29 = 0 AND concept = 'error' THEN '(F) ' {_variants} ELSE {_concept_case} END AS concept_raw,
       year, week,
       CASE WHEN (site_id + dayofmonth(day)) % 41 = 0 THEN '31-02-' || CAST(year(day) AS VARCHAR)
            ELSE strftime(day, '%-d-%-m-%Y') END AS day_text,
       CASE WHEN row_no % 23 = 0 THEN '' WHEN row_no % 17 = 0 THEN 'n/d' ELSE {fmt_es_sql('value')} END AS cell_text,
       CASE WHEN (site_id + week) % 4 = 0 THEN '' ELSE {fmt_es_sql('mean')} END AS total_text, row_no, report_row, day AS fact_day
FROM rc1"""),
    ("pc", f"""SELECT *, trim(split_part(company_code_raw, '_', 1)) AS company_code, {clean_site_sql('site_raw')} AS site,
       {clean_concept_sql('concept_raw')} AS concept, CAST(try_strptime(day_text, '%d-%m-%Y') AS DATE) AS day,
       {clean_number_sql('cell_text')} AS value, {clean_number_sql('total_text')} AS row_total
FROM rc"""),
    ("tg", """SELECT *, CASE WHEN concept IS NULL THEN 'empty concept'
       WHEN cell_text IS NULL OR trim(cell_text) = '' THEN 'null value'
       WHEN value IS NULL THEN 'unparseable value' WHEN day IS NULL THEN 'unparseable date' END AS reason
FROM pc"""),
]

ORACLE["daily_melt"] = with_(*REPORT_CTES, ("va", "SELECT * FROM tg WHERE reason IS NULL"),
                             ("per", "SELECT year, week, min(day) AS period_start, max(day) AS period_end FROM va GROUP BY ALL"),
                             final="""
SELECT company, company_code, site, category, concept, year, week, day, value,
       coalesce(row_total, CAST(sum(CAST(value AS DECIMAL(28, 10))) OVER (PARTITION BY company, site, year, week, concept_raw, report_row) AS DOUBLE)) AS row_total,
       period_start, period_end
FROM va JOIN per USING (year, week)""")

ORACLE["load_rejects"] = with_(*REPORT_CTES, final="""
SELECT company, site_raw, concept_raw, day_text, cell_text, reason FROM tg WHERE reason IS NOT NULL""")

ORACLE["load_stats"] = with_(*REPORT_CTES, ("pr", """SELECT company, site_raw, site, year, week, concept_raw, report_row,
       count(*) AS cells, count(*) FILTER (WHERE reason IS NULL) AS okc FROM tg GROUP BY ALL"""),
    ("pk", "SELECT pr.*, k.nm AS known FROM pr LEFT JOIN (SELECT DISTINCT s_name AS nm FROM supplier) k ON pr.site = k.nm"),
    final="""
SELECT CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(okc) AS BIGINT) AS inserted,
       CAST(sum(cells - okc) AS BIGINT) AS rejected_cells, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE okc < cells) AS BIGINT) AS omitted_rows,
       CAST(count(DISTINCT CASE WHEN okc > 0 THEN {'y': year, 'w': week} END) AS BIGINT) AS unique_weeks,
       CAST(count(DISTINCT CASE WHEN okc > 0 THEN {'c': company, 's': site} END) AS BIGINT) AS unique_sites,
       CAST(count(DISTINCT CASE WHEN okc > 0 AND known IS NULL THEN {'c': company, 's': site} END) AS BIGINT) AS new_sites
FROM pk""")

_ordered_patterns = sorted(WEEKLY_PATTERNS, key=lambda p: -len(p[0]))


def target_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(p)}) THEN {q(t)}" for p, t in _ordered_patterns) + " END"


ORACLE["unmapped_concepts"] = with_(*REPORT_CTES, final=f"""
SELECT DISTINCT company, site, lower(concept) AS concept FROM tg
WHERE concept IS NOT NULL AND {target_sql('lower(concept_raw)')} IS NULL""")


def _tgt(t):
    tot = davg(f"CASE WHEN target = {q(t)} THEN row_total END")
    cs = dsum(f"CASE WHEN target = {q(t)} THEN cell_sum END")
    cc = f"sum(CASE WHEN target = {q(t)} THEN cell_cnt END)"
    return f"round(coalesce({tot}, CASE WHEN {cc} <> 0 THEN {cs} / {cc} END) * 100.0) / 100.0 AS {t}"


REPORT_WEEK_CTES = [
    ("tr", f"""SELECT *, {target_sql('lower(concept_raw)')} AS target
FROM tg WHERE concept IS NOT NULL"""),
    ("rows_", f"""SELECT company, site, year, week, concept_raw, report_row, target, max(row_total) AS row_total,
       {dsum('value')} AS cell_sum, count(value) AS cell_cnt
FROM tr WHERE target IS NOT NULL GROUP BY ALL"""),
    ("w0", f"""SELECT company, site, year, week, {', '.join(_tgt(t) for t in WEEKLY_TARGETS + ['ms_pasture', 'ms_green'])}
FROM rows_ GROUP BY ALL"""),
]
ORACLE["weekly_from_report"] = with_(*REPORT_CTES, *REPORT_WEEK_CTES,
    final=f"""SELECT company, site, year, week, {', '.join(WEEKLY_TARGETS)},
       round(CASE WHEN ms_pasture IS NOT NULL OR ms_green IS NOT NULL THEN coalesce(ms_pasture, 0) + coalesce(ms_green, 0) END
             * 100.0) / 100.0 AS greens
FROM w0""")

# --------------------------------------------------------------------------- the whole weekly load

_row_id = "company, company_code_raw, site_raw, category, concept_raw, total_text, report_row, year, week"
_written = "CASE concept " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in REPORT_CONCEPTS) + " END"
LOAD_CTES = REPORT_CTES + [
    ("wr", f"""SELECT {_row_id}, min(row_no) AS row_no, CAST(date_trunc('week', min(fact_day)) AS DATE) AS monday FROM rc GROUP BY ALL"""),
    ("wd", """SELECT wr.*, CAST(i AS INTEGER) AS i, monday + CAST(i AS INTEGER) AS fact_day,
       CASE WHEN week % 3 = 0 AND i = 2 THEN '31-02-' || year ELSE strftime(monday + CAST(i AS INTEGER), '%-d-%-m-%Y') END AS day_text
FROM wr, range(7) r(i)"""),
    ("wc", f"""SELECT wd.*, rc.cell_text FROM wd LEFT JOIN rc USING ({_row_id}, fact_day)"""),
    ("lp", f"""SELECT *, trim(split_part(company_code_raw, '_', 1)) AS company_code, {clean_site_sql('site_raw')} AS site,
       {clean_concept_sql('concept_raw')} AS concept, CAST(try_strptime(day_text, '%d-%m-%Y') AS DATE) AS day,
       {clean_number_sql('cell_text')} AS value, {clean_number_sql('total_text')} AS row_total
FROM wc"""),
    ("lt", """SELECT *, CASE WHEN concept IS NULL THEN 'empty concept'
       WHEN cell_text IS NULL OR trim(cell_text) = '' THEN 'null value'
       WHEN value IS NULL THEN 'unparseable value' WHEN day IS NULL THEN 'unparseable date' END AS reason
FROM lp"""),
    ("cmp", f"""SELECT CAST(n_nationkey AS VARCHAR) AS code, CAST(n_nationkey AS BIGINT) AS company_id, n_name AS name FROM nation WHERE n_nationkey < {KNOWN_COMPANIES}"""),
    ("cnew", "SELECT DISTINCT company_code AS code FROM lt WHERE company_code NOT IN (SELECT code FROM cmp)"),
    ("codes", """SELECT code, company_id, name FROM cmp
UNION ALL SELECT code, (SELECT max(company_id) FROM cmp) + row_number() OVER (ORDER BY code), 'Empresa ' || code FROM cnew"""),
    ("sold", f"""SELECT s_suppkey AS site_id, CAST(s_suppkey % 25 AS BIGINT) AS company_id, 'Site ' || s_suppkey AS name FROM supplier
WHERE s_suppkey % 2 = 0 AND s_suppkey % 25 < {KNOWN_COMPANIES}"""),
    ("snew", """SELECT DISTINCT company_id, site AS name FROM lt JOIN codes ON company_code = code
WHERE (company_id, site) NOT IN (SELECT (company_id, name) FROM sold)"""),
    ("ls", """SELECT company_id, name, site_id FROM sold
UNION ALL SELECT company_id, name, (SELECT max(site_id) FROM sold) + row_number() OVER (ORDER BY company_id, name) FROM snew"""),
    ("li_", """SELECT lt.*, ls.site_id, ls.company_id FROM lt JOIN codes ON lt.company_code = codes.code JOIN ls ON ls.company_id = codes.company_id AND ls.name = lt.site"""),
    ("ltr", f"""SELECT *, {target_sql('lower(concept_raw)')} AS target FROM li_ WHERE concept IS NOT NULL"""),
    ("lrows", f"""SELECT site_id, company_id, year, week, concept_raw, row_no, target, max(row_total) AS row_total,
       {dsum('value')} AS cell_sum, count(value) AS cell_cnt FROM ltr WHERE target IS NOT NULL GROUP BY ALL"""),
    ("lw0", f"""SELECT site_id, company_id, year, week, {', '.join(_tgt(x) for x in WEEKLY_TARGETS + ['ms_pasture', 'ms_green'])} FROM lrows GROUP BY ALL"""),
    ("lw", f"""SELECT l.* EXCLUDE (ms_pasture, ms_green), p.period_start, p.period_end,
       round(CASE WHEN ms_pasture IS NOT NULL OR ms_green IS NOT NULL THEN coalesce(ms_pasture, 0) + coalesce(ms_green, 0) END * 100.0) / 100.0 AS greens
FROM lw0 l JOIN (SELECT year, week, min(day) AS period_start, max(day) AS period_end FROM lt GROUP BY ALL) p USING (year, week)"""),
    ("lv", f"SELECT * FROM lw WHERE coalesce({', '.join(LOAD_MEASURES)}) IS NOT NULL"),
]

ORACLE["weekly_load_daily"] = with_(*LOAD_CTES, (
    "old", f"""SELECT site_id, day, {clean_concept_sql(_written)} AS concept, CAST(company_id AS BIGINT) AS company_id, 'stored' AS category, 1.0 AS value
FROM (SELECT site_id, day, concept, min_by(company_id, row_no) AS company_id FROM ev WHERE row_no % 10 = 0 GROUP BY ALL)
WHERE site_id IN (SELECT site_id FROM sold) AND {_written} IS NOT NULL"""),
    ("nb", """SELECT site_id, day, concept, min_by(company_id, row_no) AS company_id, min_by(category, row_no) AS category, max_by(value, row_no) AS value
FROM li_ WHERE reason IS NULL GROUP BY ALL"""), final="""
SELECT site_id, day, concept, CASE WHEN o.site_id IS NOT NULL THEN o.company_id ELSE n.company_id END AS company_id,
       CASE WHEN o.site_id IS NOT NULL THEN o.category ELSE n.category END AS category, CAST(CASE WHEN n.site_id IS NOT NULL THEN n.value ELSE o.value END AS DOUBLE) AS value
FROM old o FULL OUTER JOIN nb n USING (site_id, day, concept)""")

_stored = {"area": "CAST(10 + site_id % 37 AS DOUBLE)", "weight": "CAST(5 AS DOUBLE)"}
ORACLE["weekly_load_weekly"] = with_(*LOAD_CTES, (
    "old", f"""SELECT site_id, 2024 AS year, CAST(i AS INTEGER) AS week, company_id, DATE '2000-01-01' AS period_start, DATE '2000-01-01' AS period_end,
       {', '.join(f"{_stored.get(m, 'CAST(NULL AS DOUBLE)')} AS {m}" for m in LOAD_MEASURES)} FROM sold, range(1, {STORED_WEEKS + 1}) r(i)"""), final=f"""
SELECT site_id, year, week, coalesce(o.company_id, n.company_id) AS company_id,
       CASE WHEN n.site_id IS NOT NULL THEN n.period_start ELSE o.period_start END AS period_start,
       CASE WHEN n.site_id IS NOT NULL THEN n.period_end ELSE o.period_end END AS period_end,
       {', '.join(f'coalesce(n.{m}, o.{m}) AS {m}' for m in LOAD_MEASURES)}
FROM old o FULL OUTER JOIN lv n USING (site_id, year, week)""")

ORACLE["weekly_load_sites"] = with_(*LOAD_CTES, final="""
SELECT ls.site_id, ls.company_id, ls.name, codes.code AS company_code, codes.name AS company FROM ls JOIN codes USING (company_id)""")

ORACLE["weekly_load_rejects"] = with_(*LOAD_CTES, final="""
SELECT company_code, site_raw, concept_raw, day_text, cell_text, reason FROM lt WHERE reason IS NOT NULL""")

ORACLE["weekly_load_stats"] = with_(*LOAD_CTES, ("pr", f"""SELECT {_row_id}, row_no, company_code, site, count(*) AS n, count(reason) AS bad FROM lt GROUP BY ALL"""), final="""
SELECT (SELECT count(*) FROM lt) AS cells, (SELECT count(*) FROM pr) AS rows, (SELECT count(*) FROM lt WHERE reason IS NULL) AS daily_rows,
       (SELECT count(*) FROM lv) AS weekly_rows, (SELECT count(reason) FROM lt) AS rejected_cells, (SELECT count(*) FROM pr WHERE bad > 0) AS omitted_rows,
       (SELECT count(*) FROM cnew) AS companies_created, (SELECT count(*) FROM snew) AS sites_created,
       (SELECT count(DISTINCT (year, week)) FROM pr WHERE bad < n) AS unique_weeks,
       (SELECT count(DISTINCT (company_code, site)) FROM pr WHERE bad < n) AS unique_sites""")

# --------------------------------------------------------------------------- scalar cleaning / formats / dates


def _plain2_sql(x):
    return f"replace(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',', '')"


def safe_float_sql(x):
    return f"(CASE WHEN regexp_matches(trim({x}), '{NUMBER_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


_txt = f"""CASE (l_orderkey * 7 + l_linenumber) % 7 WHEN 0 THEN {fmt_es_sql('l_extendedprice')}
  WHEN 1 THEN '$ ' || {fmt_es_sql('l_extendedprice')} WHEN 2 THEN {_plain2_sql('l_extendedprice')}
  WHEN 3 THEN replace({_plain2_sql('l_extendedprice')}, '.', ',')
  WHEN 4 THEN replace(format('{{:,.0f}}', l_quantity), ',', '') || ' %'
  WHEN 5 THEN replace(format('{{:,.0f}}', l_extendedprice * 1000), '.', ',') ELSE 'n/a' END"""
_d = safe_float_sql(_plain2_sql("l_extendedprice"))
ORACLE["clean_numbers"] = f"""
SELECT l_orderkey, l_linenumber, text, {clean_number_sql('text')} AS value,
       {safe_float_sql('CAST(l_quantity AS VARCHAR)')} AS qty_float,
       CASE WHEN {_d} IS NOT NULL AND abs({_d}) < 9223372036854775808 THEN CAST(trunc({_d}) AS BIGINT) END AS price_int
FROM (SELECT *, {_txt} AS text FROM lineitem)"""

ORACLE["clean_concepts"] = f"""
SELECT p_partkey, raw, {clean_concept_sql('raw')} AS concept,
       coalesce(contains(lower({clean_concept_sql('raw')}), 'ring'), FALSE) AS has_ring,
       lower(p_type) = 'economy' AS is_economy
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '(A) ' || p_name WHEN 1 THEN '(12)  ' || replace(p_name, ' ', '  ') || '  '
                 WHEN 2 THEN '(BB) ' ELSE '  ' || p_type || ' ' END AS raw FROM part)"""

ORACLE["clean_names"] = f"""
SELECT s_suppkey, raw, {clean_site_sql("CASE WHEN raw = 'Ag. Los Maitenes' THEN 'Los Maitenes' ELSE raw END")} AS site,
       trim(split_part(CAST(s_nationkey AS VARCHAR) || ' _' || s_name, '_', 1)) AS company_code, trim(raw) AS trimmed
FROM (SELECT *, CASE s_suppkey % 6 WHEN 0 THEN 'Fundo ' || s_name WHEN 1 THEN 'Soc. Agricola ' || s_name
                 WHEN 2 THEN 'agricola  ' || s_name || ' ' WHEN 3 THEN 'Soc. Fundo ' || s_name
                 WHEN 4 THEN 'Ag. Los Maitenes' ELSE s_name END AS raw FROM supplier)"""

ORACLE["fold_text"] = f"""
SELECT p_partkey, raw, {fold('raw').replace('lower(raw)', 'raw')} AS folded
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN upper(translate(p_name, 'aeiou', 'áéíóú'))
                 WHEN 1 THEN translate(p_name, 'aeiou', 'áéíóú') || '?' ELSE 'ñandú ' || p_brand END AS raw FROM part)"""

ORACLE["format_spanish"] = f"""
SELECT l_orderkey, l_linenumber, {fmt_es_sql('l_extendedprice')} AS price_es,
       CASE WHEN l_extendedprice * l_discount IS NULL THEN '' ELSE '$' || {fmt_es_sql('l_extendedprice * l_discount')} END
         AS discount_money,
       CASE WHEN l_tax IS NULL THEN '' ELSE {fmt_es_sql('l_tax * 100')} || '%' END AS tax_pct,
       coalesce(CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), '') AS qty_int,
       {fmt_es_sql('CASE WHEN l_linenumber <> 1 THEN -l_discount END')} AS neg_or_blank,
       l_returnflag || ' (' || l_linestatus || ')' AS flag_label
FROM lineitem"""

ORACLE["iso_week"] = """
SELECT o_orderkey, CAST(week(CAST(o_orderdate AS DATE)) AS INTEGER) AS iso_week,
       CAST(isoyear(CAST(o_orderdate AS DATE)) AS INTEGER) AS iso_year, CAST(year(o_orderdate) AS INTEGER) AS calendar_year,
       CAST(isoyear(CAST(o_orderdate AS DATE)) * 100 + week(CAST(o_orderdate AS DATE)) AS INTEGER) AS week_key,
       strftime(CAST(o_orderdate AS DATE), '%d-%m-%Y') AS day_text, strftime(o_orderdate, '%d-%m-%Y %H:%M') AS ts_text
FROM orders"""

ORACLE["week_fallback_date"] = """
SELECT o_orderkey, week, fb AS fallback_day,
       CAST(try_strptime(CASE WHEN o_orderkey % 9 = 0 THEN '31-02-2025' ELSE strftime(o_orderdate, '%-d-%-m-%Y') END,
                         '%d-%m-%Y') AS DATE) AS parsed_day,
       strftime(fb, '%d-%m-%Y') || ' al ' || strftime(fb + 6, '%d-%m-%Y') AS period
FROM (SELECT *, CAST(week(CAST(o_orderdate AS DATE)) AS INTEGER) AS week,
             DATE '2025-01-01' + CAST((week(CAST(o_orderdate AS DATE)) - 1) * 7 AS INTEGER) AS fb FROM orders)"""

# --------------------------------------------------------------------------- administration

LOGS_CTE = ("logs", """SELECT o_orderkey AS log_id, o_custkey AS user_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'weekly' ELSE 'history' END AS file_type,
       'report_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS file_name, o_orderdate AS loaded_at,
       CAST(o_orderkey % 97 AS INTEGER) AS processed, CAST(o_orderkey % 5 AS INTEGER) AS omitted,
       CASE WHEN o_orderkey % 50 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'exito'
            WHEN o_orderstatus = 'O' THEN 'error' ELSE 'warning' END AS status, o_orderpriority AS message
FROM orders""")

ORACLE["company_counts"] = """
SELECT n.n_nationkey AS company_id, n.n_name AS name, n.n_name AS code,
       CAST(coalesce(s.n_sites, 0) AS BIGINT) AS n_sites, CAST(coalesce(g.n_users, 0) AS BIGINT) AS n_users,
       n.n_name || ' (' || n.n_name || ')' AS label
FROM nation n
LEFT JOIN (SELECT s_nationkey AS company_id, count(DISTINCT s_suppkey) AS n_sites FROM supplier GROUP BY 1) s
  ON s.company_id = n.n_nationkey
LEFT JOIN (SELECT n_nationkey AS company_id, count(DISTINCT n_regionkey) AS n_users FROM nation GROUP BY 1) g
  ON g.company_id = n.n_nationkey"""

ORACLE["site_counts"] = with_(*W, *DAILY_CTES, final="""
SELECT s.s_suppkey AS site_id, s.s_name AS name, CAST(coalesce(w.n_weeks, 0) AS BIGINT) AS n_weeks,
       CAST(coalesce(d.n_days, 0) AS BIGINT) AS n_days, CAST(coalesce(d.n_daily, 0) AS BIGINT) AS n_daily
FROM supplier s
LEFT JOIN (SELECT site_id, count(DISTINCT (year, week)) AS n_weeks FROM weekly GROUP BY 1) w ON w.site_id = s.s_suppkey
LEFT JOIN (SELECT site_id, count(DISTINCT day) AS n_days, count(*) AS n_daily FROM dt GROUP BY 1) d ON d.site_id = s.s_suppkey""")

ORACLE["user_companies"] = """
SELECT CAST(r.r_regionkey AS BIGINT) AS user_id, lower(r.r_name) AS username, r.r_regionkey <> 3 AS active,
       g.companies, CAST(coalesce(g.n, 0) AS BIGINT) AS n_companies,
       CASE WHEN r.r_regionkey <> 3 THEN '✅' ELSE '❌' END AS active_symbol
FROM region r LEFT JOIN (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS companies, count(*) AS n
                          FROM nation GROUP BY 1) g ON g.n_regionkey = r.r_regionkey"""

_sym = "CASE status " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in STATUS_SYMBOLS.items()) + \
       f" ELSE {q(STATUS_DEFAULT)} END"
ORACLE["recent_logs"] = with_(LOGS_CTE, ("top", """SELECT l.*, c.c_name AS username FROM logs l
LEFT JOIN customer c ON l.user_id = c.c_custkey WHERE l.file_type IN ('weekly')
ORDER BY l.loaded_at DESC, l.log_id DESC LIMIT 100"""), final=f"""
SELECT log_id, strftime(loaded_at, '%d-%m-%Y %H:%M') AS loaded_at, username, file_type, file_name, processed, status,
       {_sym} AS status_symbol, message
FROM top""")

ORACLE["log_counters"] = with_(LOGS_CTE, final="""
SELECT file_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'exito') AS BIGINT) AS success,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors FROM logs GROUP BY 1""")

ORACLE["history_summary"] = with_(*W, HISTORY_CTE, final="""
SELECT CAST(count(DISTINCT week) AS BIGINT) AS weeks, CAST(count(DISTINCT site) AS BIGINT) AS sites,
       min(day) AS first_day, max(day) AS last_day, CAST(count(*) AS BIGINT) AS rows FROM hist""")

ORACLE["weeks_available"] = with_(*W, HISTORY_CTE, final="""
SELECT week, max(day) AS last_day, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT site) AS BIGINT) AS sites
FROM hist GROUP BY week ORDER BY week DESC LIMIT 100""")

ORACLE["week_detail"] = with_(*W, HISTORY_CTE, final=f"""
SELECT week, day, site, margin, weight FROM hist WHERE week = {DETAIL_WEEK}""")

ORACLE["data_summary"] = with_(*W, *DAILY_CTES, LOGS_CTE, final="""
SELECT 'companies' AS item, CAST(count(*) AS BIGINT) AS value FROM nation
UNION ALL SELECT 'sites', count(*) FROM supplier
UNION ALL SELECT 'users', count(*) FROM region
UNION ALL SELECT 'weekly', count(*) FROM weekly
UNION ALL SELECT 'daily', count(*) FROM dt
UNION ALL SELECT 'logs', count(*) FROM logs
UNION ALL SELECT 'latest_week_key', (SELECT year * 100 + week FROM weekly ORDER BY year DESC, week DESC LIMIT 1)
UNION ALL SELECT 'latest_day', CAST(strftime(max(day), '%Y%m%d') AS BIGINT) FROM dt""")

ORACLE["distinct_values"] = with_(*W, *DAILY_CTES, final=f"""
SELECT DISTINCT * FROM (
  SELECT 'day' AS kind, strftime(day, '%d-%m-%Y') AS value FROM dt
  UNION ALL SELECT 'period', strftime(period_start, '%d-%m-%Y') || ' al ' || strftime(period_end, '%d-%m-%Y')
            FROM weekly WHERE period_start IS NOT NULL AND period_end IS NOT NULL
  UNION ALL SELECT 'site', s_name FROM supplier
  UNION ALL SELECT 'category', category FROM dt
  UNION ALL SELECT 'concept', concept FROM dt)""")

# --------------------------------------------------------------------------- upserts, deletes, moves

ORACLE["upsert_daily"] = with_(DAILY_CTES[0], (
    "old", """SELECT site_id, day, concept, min_by(company_id, row_no) AS company_id, min_by(category, row_no) AS category,
       max_by(value, row_no) AS value FROM ev WHERE row_no % 2 = 0 GROUP BY ALL"""),
    ("nb", """SELECT site_id, day, concept, max_by(company_id, row_no) AS company_id, max_by(upper(category), row_no) AS category,
       max_by(value, row_no) AS value FROM ev WHERE row_no % 2 = 1 GROUP BY ALL"""), final="""
SELECT site_id, day, concept, CASE WHEN o.site_id IS NOT NULL THEN o.company_id ELSE n.company_id END AS company_id,
       CASE WHEN o.site_id IS NOT NULL THEN o.category ELSE n.category END AS category,
       CASE WHEN n.site_id IS NOT NULL THEN n.value ELSE o.value END AS value
FROM old o FULL OUTER JOIN nb n USING (site_id, day, concept)""")

ORACLE["upsert_stamped"] = with_(DAILY_CTES[0], (
    "old", """SELECT site_id, day, concept, min_by(company_id, row_no) AS company_id, min_by(category, row_no) AS category,
       max_by(value, row_no) AS value FROM ev WHERE row_no % 2 = 0 GROUP BY ALL"""),
    ("nb", """SELECT site_id, day, concept, company_id, category, CASE WHEN row_no % 3 = 0 THEN value END AS value FROM ev WHERE row_no % 2 = 1
QUALIFY row_number() OVER (PARTITION BY site_id, day, concept ORDER BY row_no DESC) = 1"""), final=f"""
SELECT site_id, day, concept, CASE WHEN o.site_id IS NOT NULL THEN o.company_id ELSE n.company_id END AS company_id,
       CASE WHEN o.site_id IS NOT NULL THEN o.category ELSE n.category END AS category, coalesce(n.value, o.value) AS value,
       CASE WHEN o.site_id IS NULL OR (n.value IS NOT NULL AND n.value IS DISTINCT FROM o.value) THEN TIMESTAMP '{LOADED_AT}' ELSE TIMESTAMP '{STORED_AT}' END AS updated_at
FROM old o FULL OUTER JOIN nb n USING (site_id, day, concept)""")

ORACLE["config_defaults"] = with_((
    "tg", "SELECT 'region.' || r_name AS key, CAST(to_json({'id': r_regionkey}) AS VARCHAR) AS value, 'init' AS updated_by FROM region"), final="""
SELECT * FROM tg UNION ALL SELECT 'nation.' || n_name, CAST(to_json({'id': -1}) AS VARCHAR), 'default' FROM nation""")

ORACLE["upsert_weekly_partial"] = with_(*W, (
    "tg", "SELECT * FROM weekly WHERE run_week % 3 <> 0"),
    ("nb", """SELECT site_id, year, week, period_start + 1 AS period_start, period_end + 1 AS period_end,
       CASE WHEN (site_id + run_week) % 3 <> 0 THEN round(margin * 1.1 * 100.0) / 100.0 END AS margin,
       CASE WHEN (site_id + run_week) % 4 <> 0 THEN fat + 1 END AS fat, CAST(NULL AS DOUBLE) AS prod, weight
FROM weekly WHERE run_week % 2 = 0"""), final="""
SELECT site_id, year, week,
       CASE WHEN n.site_id IS NOT NULL THEN n.period_start ELSE o.period_start END AS period_start,
       CASE WHEN n.site_id IS NOT NULL THEN n.period_end ELSE o.period_end END AS period_end,
       coalesce(n.margin, o.margin) AS margin, coalesce(n.fat, o.fat) AS fat, coalesce(n.prod, o.prod) AS prod,
       coalesce(n.weight, o.weight) AS weight
FROM tg o FULL OUTER JOIN nb n USING (site_id, year, week)""")

ORACLE["upsert_margin"] = with_(*W, (
    "tg", "SELECT site_id, company_id, week, year, margin, weight FROM weekly WHERE run_week % 2 = 1"),
    ("nb", f"""SELECT site_id, company_id, week, coalesce(CASE WHEN run_week % 10 <> 0 THEN year END, {MARGIN_DEFAULT_YEAR}) AS year,
       margin + 1 AS margin, weight FROM weekly WHERE margin IS NOT NULL"""), final="""
SELECT site_id, week, year, CASE WHEN o.site_id IS NOT NULL THEN o.company_id ELSE n.company_id END AS company_id,
       CASE WHEN n.site_id IS NOT NULL THEN n.margin ELSE o.margin END AS margin,
       CASE WHEN n.site_id IS NOT NULL THEN n.weight ELSE o.weight END AS weight
FROM tg o FULL OUTER JOIN nb n USING (site_id, week, year)""")

ORACLE["upsert_config"] = with_((
    "tg", "SELECT 'region.' || r_name AS key, to_json({'id': r_regionkey}) AS value, 'init' AS updated_by FROM region"),
    ("nx", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    ("inc", """SELECT 'region.' || r_name AS key, to_json({'id': n_nationkey}) AS value, 'admin' AS updated_by, n_nationkey AS ord FROM nx
UNION ALL SELECT 'nation.' || n_name, to_json({'id': n_nationkey}), 'admin', n_nationkey FROM nx"""),
    ("nb", "SELECT key, max_by(value, ord) AS value, max_by(updated_by, ord) AS updated_by FROM inc GROUP BY key"), final="""
SELECT key, CAST(CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS VARCHAR) AS value,
       CASE WHEN n.key IS NOT NULL THEN n.updated_by ELSE o.updated_by END AS updated_by
FROM tg o FULL OUTER JOIN nb n USING (key)""")

ORACLE["load_dimensions"] = with_((
    "ex", "SELECT n_name AS code, CAST(n_nationkey AS BIGINT) AS company_id FROM nation WHERE n_nationkey < 20"),
    ("nw", "SELECT DISTINCT n_name AS code FROM nation WHERE n_name NOT IN (SELECT code FROM ex)"), final="""
SELECT code, company_id FROM ex
UNION ALL SELECT code, (SELECT max(company_id) FROM ex) + row_number() OVER (ORDER BY code) FROM nw""")

ORACLE["get_or_create_sites"] = with_((
    "ex", "SELECT s_nationkey AS company_id, s_name AS name, CAST(s_suppkey AS BIGINT) AS site_id FROM supplier WHERE s_suppkey % 2 = 0"),
    ("inc", "SELECT DISTINCT CAST(trim(split_part(CAST(s_nationkey AS VARCHAR) || '_' || s_name, '_', 1)) AS INTEGER) AS company_id, s_name AS name FROM supplier"),
    ("nw", "SELECT * FROM inc WHERE (company_id, name) NOT IN (SELECT (company_id, name) FROM ex)"), final="""
SELECT company_id, name, site_id FROM ex
UNION ALL SELECT company_id, name, (SELECT max(site_id) FROM ex) + row_number() OVER (ORDER BY company_id, name) FROM nw""")

FIRST_SITE_CTE = ("fs", f"""SELECT company_key, min(s_suppkey) AS site_id, arg_min(s_nationkey, s_suppkey) AS company_id, arg_min(s_name, s_suppkey) AS name
FROM (SELECT s.*, lower({clean_site_sql('n.n_name')}) AS company_key FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey) GROUP BY company_key""")
ORACLE["first_site_per_company"] = with_(FIRST_SITE_CTE, final="SELECT * FROM fs")

MARGIN_CTES = [*W, FIRST_SITE_CTE, (
    "mr", """SELECT w.site_id * 100000 + run_week AS row_no, CASE WHEN k % 17 = 0 THEN 'Otra ' || n_name WHEN k % 3 = 0 THEN 'Soc. Agricola ' || n_name
       WHEN k % 3 = 1 THEN upper(n_name) ELSE ' ' || n_name || ' ' END AS emp,
       CASE WHEN k % 23 = 0 THEN 'x' ELSE CAST(week AS VARCHAR) END AS semana, CASE WHEN run_week % 10 <> 0 THEN CAST(year AS VARCHAR) END AS anio,
       CASE WHEN k % 19 = 0 THEN 'n/d' ELSE replace(format('{:,.2f}', margin), ',', '') END AS mdat, CASE WHEN k % 29 <> 0 THEN CAST(weight AS VARCHAR) END AS vacas
FROM (SELECT *, site_id + run_week AS k FROM weekly) w JOIN nation ON w.company_id = n_nationkey"""),
    ("mk", f"""SELECT mr.*, fs.site_id, fs.company_id, CASE WHEN fs.site_id IS NULL THEN 'unknown company' WHEN semana = 'x' OR mdat = 'n/d' THEN 'processing error'
       WHEN mdat IS NULL THEN 'empty margin' END AS reason FROM mr LEFT JOIN fs ON lower({clean_site_sql('emp')}) = fs.company_key"""),
    ("mg", f"""SELECT site_id, CAST(semana AS INTEGER) AS week, CAST(coalesce(anio, '{MARGIN_DEFAULT_YEAR}') AS INTEGER) AS year, max_by(company_id, row_no) AS company_id,
       max_by(CAST(mdat AS DOUBLE), row_no) AS margin, arg_max_null(CAST(vacas AS BIGINT), row_no) AS weight FROM (SELECT * FROM mk WHERE reason IS NULL AND semana <> 'x') GROUP BY 1, 2, 3""")]
ORACLE["margin_load"] = with_(*MARGIN_CTES, ("tg", "SELECT * FROM weekly WHERE run_week % 2 = 1 AND site_id IN (SELECT site_id FROM fs)"), final="""
SELECT site_id, week, year, CASE WHEN o.site_id IS NOT NULL THEN o.company_id ELSE n.company_id END AS company_id,
       CASE WHEN n.site_id IS NOT NULL THEN n.margin ELSE o.margin END AS margin, CASE WHEN n.site_id IS NOT NULL THEN n.weight ELSE o.weight END AS weight
FROM tg o FULL OUTER JOIN mg n USING (site_id, week, year)""")
ORACLE["margin_load_rejects"] = with_(*MARGIN_CTES, final="SELECT row_no, emp AS company, reason FROM mk WHERE reason IS NOT NULL")
ORACLE["margin_load_stats"] = with_(*MARGIN_CTES, final=f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE reason IS NULL) AS loaded, count(reason) AS omitted,
       count(DISTINCT CASE WHEN reason IS NULL THEN (semana, coalesce(anio, '{MARGIN_DEFAULT_YEAR}')) END) AS unique_weeks FROM mk""")

ORACLE["delete_period"] = with_(*W, final=f"""
SELECT site_id, year, week FROM weekly w WHERE NOT EXISTS (
  SELECT 1 FROM weekly d WHERE d.run_week = {PERIOD_RUN_WEEK} AND d.period_start = w.period_start AND d.period_end = w.period_end)""")

ORACLE["delete_latest_period"] = with_(*W, ("lp", "SELECT period_start, period_end FROM weekly ORDER BY period_start DESC, period_end DESC LIMIT 1"), final="""
SELECT site_id, year, week FROM weekly w WHERE NOT EXISTS (
  SELECT 1 FROM lp WHERE lp.period_start = w.period_start AND lp.period_end = w.period_end)""")

_DAILY_PERIODS = ("dp", """SELECT DISTINCT site_id, CAST(date_trunc('week', day) AS DATE) AS period_start, CAST(date_trunc('week', day) AS DATE) + 6 AS period_end
FROM ev WHERE site_id % 3 <> 0""")
_days_left = """SELECT site_id, day, concept, value FROM dt WHERE NOT EXISTS (
  SELECT 1 FROM pd WHERE pd.site_id = dt.site_id AND dt.day BETWEEN pd.period_start AND pd.period_end)"""
ORACLE["delete_period_daily"] = with_(*DAILY_CTES, _DAILY_PERIODS, ("pd", f"SELECT * FROM dp WHERE period_start = DATE '{DAILY_PERIOD[0]}' AND period_end = DATE '{DAILY_PERIOD[1]}'"),
                                      final=_days_left)
ORACLE["delete_latest_period_daily"] = with_(*DAILY_CTES, _DAILY_PERIODS, ("pd", "SELECT * FROM dp WHERE period_start = (SELECT max(period_start) FROM dp)"), final=_days_left)

ORACLE["cascade_delete"] = with_(*W, *DAILY_CTES, HISTORY_CTE, final=f"""
SELECT 'sites' AS "table", CAST(count(*) AS BIGINT) AS rows FROM supplier WHERE s_nationkey <> {CASCADE_COMPANY}
UNION ALL SELECT 'weekly', count(*) FROM weekly WHERE company_id <> {CASCADE_COMPANY}
UNION ALL SELECT 'daily', count(*) FROM dt WHERE company_id <> {CASCADE_COMPANY}
UNION ALL SELECT 'history', count(*) FROM hist WHERE site NOT IN (SELECT s_name FROM supplier WHERE s_nationkey = {CASCADE_COMPANY})""")

ORACLE["move_site"] = with_(*W, final="""
SELECT site_id, year, week, CAST(CASE WHEN site_id % 10 = 0 THEN (s.s_nationkey + 1) % 25 ELSE w.company_id END AS INTEGER) AS company_id
FROM weekly w JOIN supplier s ON s.s_suppkey = w.site_id""")

ORACLE["move_site_dimension"] = """
SELECT s_suppkey AS site_id, s_name AS name, CAST(CASE WHEN s_suppkey % 10 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END AS INTEGER) AS company_id
FROM supplier"""

ORACLE["retention"] = with_(LOGS_CTE, final=f"""
SELECT CAST(count(*) FILTER (WHERE loaded_at < DATE '{RETENTION_AS_OF}' - {RETENTION_DAYS}) AS BIGINT) AS removed,
       CAST(count(*) FILTER (WHERE NOT (loaded_at < DATE '{RETENTION_AS_OF}' - {RETENTION_DAYS})) AS BIGINT) AS kept FROM logs""")

# --------------------------------------------------------------------------- history report load


def safe_int_sql(x):
    d = safe_float_sql(x)
    return f"(CASE WHEN {d} IS NOT NULL AND abs({d}) < 9223372036854775808 THEN CAST(trunc({d}) AS BIGINT) END)"


HIST_REPORT_CTES = [
    ("hr", """SELECT o_orderkey AS row_no,
       CASE WHEN o_orderkey % 62 = 0 THEN NULL ELSE 'Co ' || CAST(o_custkey % 7 AS VARCHAR) END AS emp,
       CASE WHEN o_orderkey % 37 = 0 THEN 'x' ELSE CAST(week(o_orderdate) AS VARCHAR) END AS semana,
       CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'Site ' || CAST(o_custkey % 40 AS VARCHAR) END AS est,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%-d-%-m-%Y') END AS fecha,
       replace(format('{:,.2f}', o_totalprice / 100), ',', '') AS mdat,
       format('{:,.2f}', CAST(o_custkey % 300 AS DOUBLE) + 0.75) AS vacas, """ + ", ".join(
        f"""CASE WHEN (o_orderkey + {factor}) % 17 <> 0 THEN CAST((o_orderkey * {factor}) % {most} // 100 AS VARCHAR) || '.' || lpad(CAST((o_orderkey * {factor}) % 100 AS VARCHAR), 2, '0') END AS t_{m}"""
        for _, m, factor, most in REPORT_MEASURES) + """
FROM orders"""),
    ("rec", f"""SELECT row_no, {safe_int_sql('semana')} AS week,
       trim(coalesce(nullif(trim(est), ''), nullif(trim(emp), ''))) AS site,
       CAST(try_strptime(trim(fecha), '%d-%m-%Y') AS DATE) AS day, {safe_float_sql('mdat')} AS margin,
       {safe_int_sql('vacas')} AS weight, {', '.join(f"{(safe_int_sql if HISTORY_MEASURES[m] == 'long' else safe_float_sql)('t_' + m)} AS {m}" for _, m, _, _ in REPORT_MEASURES)}
FROM hr"""),
]
_measures = ["margin", "weight", *(m for _, m, _, _ in REPORT_MEASURES)]


def _history_after(where: str, name: str) -> list[tuple[str, str]]:
    """CTEs of the history after loading the report's rows that meet ``where``."""
    return [(f"rec_{name}", f"SELECT * FROM rec WHERE {where}"),
            (f"modal_{name}", f"""SELECT week, day AS modal_day FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, first_row) AS rn FROM (
  SELECT week, day, count(*) AS n, min(row_no) AS first_row FROM rec_{name} WHERE week IS NOT NULL AND day IS NOT NULL GROUP BY ALL)) WHERE rn = 1"""),
            (name, f"""SELECT r.* REPLACE (coalesce(r.day, m.modal_day, DATE '2025-01-01' + CAST((r.week - 1) * 7 AS INTEGER)) AS day)
FROM rec_{name} r LEFT JOIN modal_{name} m USING (week) WHERE r.week IS NOT NULL AND r.site IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY r.week, r.site ORDER BY r.row_no DESC) = 1""")]



ORACLE["history_rejects"] = with_(*HIST_REPORT_CTES, final=f"""
SELECT row_no, concat_ws(' | ', CASE WHEN week IS NULL THEN {q(REASON_NO_WEEK)} END,
                         CASE WHEN site IS NULL THEN {q(REASON_NO_SITE)} END) AS reason
FROM rec WHERE week IS NULL OR site IS NULL""")

ORACLE["history_load"] = with_(*HIST_REPORT_CTES, *_history_after("TRUE", "loaded"), final="SELECT * EXCLUDE (row_no) FROM loaded")
ORACLE["upsert_history_full"] = with_(*HIST_REPORT_CTES, *_history_after("row_no % 2 = 1", "old"), *_history_after("row_no % 3 = 0", "nb"), final=f"""
SELECT week, site, {', '.join(f'CASE WHEN n.site IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}' for c in ['day', *_measures])}
FROM old o FULL OUTER JOIN nb n USING (week, site)""")

# --------------------------------------------------------------------------- sessions


def _sess(g):
    return f"""SELECT user_id, {g} AS gap_minutes, min(ts) AS session_start, max(ts) AS session_end,
       CAST(count(*) AS BIGINT) AS n_events FROM (
  SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                     OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {g} MINUTE
                   THEN 1 ELSE 0 END AS new_s FROM events))
GROUP BY user_id, sid"""


ORACLE["sessions"] = "\nUNION ALL\n".join(_sess(g) for g in SESSION_GAPS)

# --------------------------------------------------------------------------- report matrix, margin rejects

_REPORT_HIST = ("hist", """SELECT week, CAST(NULL AS DATE) AS day, site, margin, weight FROM (
  SELECT CAST(floor(datediff('day', DATE '1995-01-02', make_date(year, 1, 4)) / 7) + week AS INTEGER) AS week, site, margin, weight FROM w0)
WHERE week < (SELECT max(floor(datediff('day', DATE '1995-01-02', make_date(year, 1, 4)) / 7) + week) FROM w0)
  AND week >= (SELECT max(floor(datediff('day', DATE '1995-01-02', make_date(year, 1, 4)) / 7) + week) FROM w0) - 52""")
ORACLE["report_matrix"] = with_(*REPORT_CTES, *REPORT_WEEK_CTES, (
    "lw", "SELECT year, week FROM tg ORDER BY year DESC, week DESC LIMIT 1"),
    ("rrows", f"""SELECT site, concept, max(row_total) AS total, {dsum('value')} AS cell_sum, count(value) AS cell_cnt
FROM tg JOIN lw USING (year, week) WHERE concept IS NOT NULL GROUP BY site, concept, concept_raw, report_row"""),
    *DICT_CTES,
    ("stored", f"SELECT 'Site ' || site_id AS site, {clean_concept_sql(_concept_case)} AS concept, value FROM dt"),
    ("dmean", f"""SELECT site, concept_key, {dsum('value')} AS cell_sum, count(value) AS cell_cnt FROM (
  SELECT s.*, coalesce(d.concept_key, f.k2) AS concept_key FROM stored s LEFT JOIN dict d ON s.concept = d.spelling LEFT JOIN dict_f f ON {fold('s.concept')} = f.folded
  WHERE s.concept IS NOT NULL) GROUP BY ALL"""),
    *[c for c in matrix_ctes("rrows", cells=True, hist_cte=_REPORT_HIST, daily_cte="dmean") if c not in DICT_CTES],
    final=matrix_select("body", False) + "\nUNION ALL\n" + matrix_select("tot", True))

ORACLE["margin_rejects"] = with_(*W, ("inc", """SELECT CASE WHEN w.site_id % 9 = 0 THEN 'Unknown ' || s.s_name ELSE s.s_name END AS site,
       w.year, w.week, w.margin FROM weekly w JOIN supplier s ON w.site_id = s.s_suppkey"""), final="""
SELECT site, year, week, 'unknown site' AS reason FROM inc WHERE site NOT IN (SELECT s_name FROM supplier)
UNION ALL
SELECT site, year, week, 'empty margin' FROM inc WHERE site IN (SELECT s_name FROM supplier) AND margin IS NULL""")


ORACLE["weeks_by_date"] = with_(*W, HISTORY_CTE, final="""
SELECT week, day, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT site) AS BIGINT) AS sites
FROM hist GROUP BY week, day""")

ORACLE["history_by_date"] = with_(*W, HISTORY_CTE, ("hc", """SELECT h.week, h.day, n.n_name AS company, h.site, h.margin, h.weight
FROM hist h JOIN supplier s ON s.s_name = h.site JOIN nation n ON n.n_nationkey = s.s_nationkey"""), final=f"""
SELECT * FROM hc WHERE day >= (SELECT max(day) FROM hc) - {7 * HISTORY_WEEKS_BACK}
  AND lower(company) = lower({q(HISTORY_COMPANY)})""")

# --------------------------------------------------------------------------- lock-outs (recursive walk per user)

_IGN = "(st.until IS NOT NULL AND a.ts < st.until)"
ORACLE["lockouts"] = f"""
WITH RECURSIVE a AS (
  SELECT user_id, ts, event_id, event_type = 'signup' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('error', 'signup')),
st AS (
  SELECT user_id, rn, ts, event_id,
         CASE WHEN ok THEN 0 WHEN 1 >= {MAX_FAILURES} THEN 0 ELSE 1 END AS cnt,
         CASE WHEN NOT ok AND 1 >= {MAX_FAILURES} THEN ts + INTERVAL {BLOCK_MINUTES} MINUTE END AS until,
         (NOT ok AND 1 >= {MAX_FAILURES}) AS blocked
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.rn, a.ts, a.event_id,
         CASE WHEN {_IGN} THEN st.cnt WHEN a.ok THEN 0 WHEN st.cnt + 1 >= {MAX_FAILURES} THEN 0 ELSE st.cnt + 1 END,
         CASE WHEN {_IGN} THEN st.until WHEN a.ok THEN NULL
              WHEN st.cnt + 1 >= {MAX_FAILURES} THEN a.ts + INTERVAL {BLOCK_MINUTES} MINUTE ELSE st.until END,
         (NOT {_IGN}) AND NOT a.ok AND st.cnt + 1 >= {MAX_FAILURES}
  FROM st JOIN a ON a.user_id = st.user_id AND a.rn = st.rn + 1)
SELECT user_id, ts AS blocked_at, until AS blocked_until, event_id AS attempt_no FROM st WHERE blocked"""

# --------------------------------------------------------------------------- stored history, sketches, collation, dimension load, readers

ORACLE["day_detail"] = with_(*W, HISTORY_CTE, final=f"""
SELECT week, day, site, margin, weight FROM hist WHERE day = DATE '{DETAIL_DAY}'""")

ORACLE["history_sketches"] = with_(*W, HISTORY_CTE, final="""
SELECT CAST(week AS BIGINT) AS "group", count(DISTINCT site) AS exact, TRUE AS within_bound, TRUE AS merged_equal FROM hist GROUP BY week
UNION ALL SELECT NULL, count(DISTINCT site), TRUE, TRUE FROM hist""")

_typed = "list_extract([" + ", ".join(q(s.strip()) for s, _ in CONCEPT_SPELLINGS) + f"], CAST(p_partkey % {len(CONCEPT_SPELLINGS)} + 1 AS BIGINT))"
_combining = _typed
for _plain, _mark, _composed in (("a", "\u0301", "á"), ("e", "\u0301", "é"), ("i", "\u0301", "í"), ("o", "\u0301", "ó"), ("n", "\u0303", "ñ")):
    _combining = f"replace({_combining}, {q(_composed)}, {q(_plain + _mark)})"
ORACLE["concept_by_collation"] = with_(*DICT_CTES, ("typed", f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper({_typed}) WHEN 1 THEN {_combining}
       WHEN 2 THEN translate({_typed}, 'aeiou', 'âêîôû') ELSE {_typed} || ' x' END AS concept FROM part"""), ("dk", """SELECT strip_accents(lower(trim(spelling))) AS folded,
       min(concept_key) AS concept_key FROM dict GROUP BY 1"""), final="""
SELECT p_partkey, concept, concept_key FROM typed LEFT JOIN dk ON strip_accents(lower(nfc_normalize(trim(concept)))) = dk.folded""")

ORACLE["load_dimension_sites"] = with_((
    "ex", "SELECT s_nationkey AS company_id, s_name AS name, CAST(s_suppkey AS BIGINT) AS site_id FROM supplier WHERE s_suppkey % 3 = 0"),
    ("nw", """SELECT DISTINCT s_nationkey AS company_id, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 7
AND (s_nationkey, s_name) NOT IN (SELECT (company_id, name) FROM ex)"""), final="""
SELECT company_id, name, site_id FROM ex
UNION ALL SELECT company_id, name, (SELECT max(site_id) FROM ex) + row_number() OVER (ORDER BY company_id, name) FROM nw""")

ORACLE["session_retention"] = f"""
SELECT user_id, session_start, session_end, n_events, user_id % 4 <> 0 AS active FROM ({_sess(SESSION_GAPS[0])})
WHERE NOT (session_end + INTERVAL {SESSION_LIFE_DAYS} DAY < TIMESTAMP '{SESSIONS_AS_OF}'
           OR (user_id % 4 = 0 AND session_end < TIMESTAMP '{SESSIONS_AS_OF}' - INTERVAL 7 DAY))"""

ORACLE["history_report_clean"] = f"""
SELECT row_no, day, CASE WHEN week <> 'x' THEN CAST(week AS BIGINT) END AS week, {clean_site_sql("CASE WHEN site = 'Ag. Los Maitenes' THEN 'Los Maitenes' ELSE site END")} AS site,
       {clean_number_sql('mdat')} AS margin
FROM (SELECT o_orderkey AS row_no, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(week(o_orderdate) AS VARCHAR) END AS week,
        CASE o_orderkey % 5 WHEN 0 THEN 'Ag. Los Maitenes' WHEN 1 THEN 'Fundo Site ' || (o_custkey % 40) ELSE 'Site ' || (o_custkey % 40) END AS site,
        CASE WHEN o_orderkey % 7 <> 0 THEN {fmt_es_sql('o_totalprice / 100')} END AS mdat FROM orders)"""
