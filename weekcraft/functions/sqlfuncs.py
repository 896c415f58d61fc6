"""SQL registration of the cleaning functions (UDF-5): SQL users call the same built-in
expressions as the DataFrame API. These are SQL-bodied functions (``CREATE TEMPORARY
FUNCTION ... RETURN <expr>``), which Catalyst inlines: no Python runs per row."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from weekcraft.functions.clean import _PY_WHITESPACE, SITE_PREFIXES
from weekcraft.functions.concepts import COLLATION, CONCEPT_SPELLINGS

# The characters that the Column API strips, no-break space and byte order mark included.
_BLANKS = "'" + "".join(f"\\u{ord(c):04X}" for c in _PY_WHITESPACE) + "'"
_NUM = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_T = "regexp_replace(regexp_replace(x, '^[\\\\s\\\\u00A0\\\\uFEFF]+|[\\\\s\\\\u00A0\\\\uFEFF]+$', ''), '[$% ]', '')"
# The prefixes of site names in their order, each at most once (a raw text: its backslashes are the pattern's own).
_PREFIXES = "r'(?i)^" + "".join(f"(?:{re.escape(p)} [\\s\\u00A0\\uFEFF]*)?" for p in SITE_PREFIXES) + "'"
_KEYS = " ".join(f"WHEN btrim(x) COLLATE {COLLATION} = '{spelling.strip()}' THEN '{key}'" for spelling, key in CONCEPT_SPELLINGS)

FUNCTIONS = {
    "wc_clean_number": ("x STRING", "DOUBLE", f"""
        CASE WHEN (CASE WHEN instr({_T}, '.') > 0 AND instr({_T}, ',') > 0
                        THEN replace(replace({_T}, '.', ''), ',', '.')
                        WHEN instr({_T}, ',') > 0 THEN replace({_T}, ',', '.') ELSE {_T} END) RLIKE '{_NUM}'
             THEN try_cast(CASE WHEN instr({_T}, '.') > 0 AND instr({_T}, ',') > 0
                                THEN replace(replace({_T}, '.', ''), ',', '.')
                                WHEN instr({_T}, ',') > 0 THEN replace({_T}, ',', '.') ELSE {_T} END AS DOUBLE) END"""),
    "wc_clean_concept": ("x STRING", "STRING", f"""
        nullif(btrim(regexp_replace(regexp_replace(btrim(x, {_BLANKS}), '^\\\\([A-Za-z0-9]+\\\\)\\\\s*', ''), ' {{2,}}', ' '), {_BLANKS}), '')"""),
    "wc_fmt_es": ("x DOUBLE", "STRING", "coalesce(translate(format_number(x, 2), ',.', '.,'), '')"),
    "wc_parse_day": ("x STRING", "DATE", f"try_to_date(btrim(x, {_BLANKS}), 'd-M-yyyy')"),
    "wc_site_name": ("x STRING", "STRING", f"btrim(regexp_replace(btrim(x, {_BLANKS}), {_PREFIXES}, ''), {_BLANKS})"),
    "wc_concept_key": ("x STRING", "STRING", f"CASE {_KEYS} END"),
    "wc_company_code": ("x STRING", "STRING", f"btrim(substring_index(x, '_', 1), {_BLANKS})"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body.strip()}")
    return list(FUNCTIONS)
