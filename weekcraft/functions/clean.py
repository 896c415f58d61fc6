"""Scalar cleaning, parsing and formatting expressions (STR-*, NUM-*, DT-*, FMT-*, MAP-1, JSON-*).

Every function maps ``Column -> Column`` using built-in Spark functions only, so the
expressions stay inside whole-stage codegen; no Python UDF is involved. ANSI mode is on
in Spark 4, so dirty text is always parsed with ``try_*`` functions.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Site-name prefixes, tested in this order, each at most once, case-insensitively,
# and only when followed by a space.
SITE_PREFIXES = ["Soc. Agricola", "Soc. Agr.", "Agricola", "Agr.", "Ag.", "Fundo", "Soc."]
# Literal site-name replacement applied to history reports.
SITE_LITERAL_REPLACEMENTS = {"Ag. Los Maitenes": "Los Maitenes"}
# Header shape of a day column in wide reports (d-m-yyyy).
DATE_HEADER_PATTERN = r"^\d{1,2}-\d{1,2}-\d{4}$"
# Fallback base date for a week number with no usable date: base + (week - 1) weeks.
WEEK_FALLBACK_BASE = "2025-01-01"

# Accent folding: every precomposed Latin letter whose canonical decomposition starts with an
# ASCII letter, built from the Unicode data; combining marks themselves (U+0300-036F) are dropped.
_FOLDED = {chr(c): d[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
           if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
_MARKS = "".join(map(chr, range(0x300, 0x370)))

# Numbers of this size or more are rejected: sums are exact decimals with 28 digits before the point.
LARGEST = 1e15
# Week numbers whose fallback date is a calendar date (about the years 108 to 9690).
WEEK_RANGE = (-100_000, 400_000)

# A plain decimal number after separators were normalised (no nan/inf/underscores,
# which the two SQL engines parse differently).
_NUMBER_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_WS = "[\\s\\u00A0\\uFEFF]"
# Characters Python's ``str.strip()`` removes (``str.isspace``), plus the BOM.
_PY_WHITESPACE = "".join(chr(c) for c in range(0x3000 + 1) if chr(c).isspace()) + "\ufeff"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: also removes NBSP/BOM, which Spark ``trim`` keeps (STR-7).

    ``btrim`` with an explicit character set: no regex per row."""
    return F.btrim(_c(c).cast("string"), F.lit(_PY_WHITESPACE))


def clean_number(c) -> Column:
    """Locale-tolerant number parse (STR-1).

    ``$``, ``%`` and spaces are dropped; with both ``.`` and ``,`` the dot is a thousands
    separator and the comma the decimal mark; a lone comma is a decimal mark; a lone dot
    stays. Anything else that is not a plain number gives null.
    """
    t = F.translate(strip_ws(c), "$% ", "")
    has_dot, has_comma = t.contains("."), t.contains(",")
    t = (F.when(has_dot & has_comma, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", "."))
         .when(has_comma, F.translate(t, ",", "."))
         .otherwise(t))
    return F.when(t.rlike(_NUMBER_RE), t.try_cast("double"))


def clean_concept(c) -> Column:
    """Strip a ``(X) `` prefix, collapse runs of spaces; empty gives null (STR-2)."""
    t = strip_ws(c)
    t = F.regexp_replace(t, r"^\([A-Za-z0-9]+\)\s*", "")
    t = strip_ws(F.regexp_replace(t, " {2,}", " "))
    return F.when(t != "", t)


def clean_site_name(c) -> Column:
    """Remove the known prefixes in order, each at most once (STR-3).

    One anchored regex of optional groups, one group per prefix in the fixed order:
    greedy optional groups consume each prefix once, in sequence, exactly like testing
    the prefixes one after the other and stripping after each removal.
    """
    ws = "[\\s\\u00A0\\uFEFF]"
    groups = "".join(f"(?:{re.escape(p)} {ws}*)?" for p in SITE_PREFIXES)
    return strip_ws(F.regexp_replace(strip_ws(c), f"(?i)^{groups}", ""))


def fold_text(c) -> Column:
    """Drop accents (composed or not) and the characters ``�`` and ``?`` (STR-4)."""
    return F.translate(_c(c), "".join(_FOLDED) + _MARKS + "�?", "".join(_FOLDED.values()))  # those past the letters are deleted


def company_code(c) -> Column:
    """Text before the first ``_``, trimmed (STR-6)."""
    return strip_ws(F.substring_index(_c(c), "_", 1))


def contains_ci(c, pattern: str) -> Column:
    """Case-insensitive containment (STR-9)."""
    return F.lower(_c(c)).contains(pattern.lower())


def equals_ci(a, b) -> Column:
    """Case-insensitive equality (STR-10)."""
    return F.lower(_c(a)) == F.lower(_c(b))


def replace_literals(c, mapping: dict) -> Column:
    """Whole-value literal replacement (STR-8), as ``DataFrame.replace`` on one column."""
    out = _c(c)
    for old, new in mapping.items():
        out = F.when(out == old, F.lit(new)).otherwise(out)
    return out


def period_label(start, end) -> Column:
    """``dd-mm-yyyy al dd-mm-yyyy`` (STR-11)."""
    return F.concat_ws(" al ", F.date_format(_c(start), "dd-MM-yyyy"), F.date_format(_c(end), "dd-MM-yyyy"))


def key_label(name, code) -> Column:
    """``name (code)`` (STR-11)."""
    return F.format_string("%s (%s)", _c(name), _c(code))


def safe_float(c) -> Column:
    """``float(x)`` or null (NUM-1)."""
    t = strip_ws(c)
    return F.when(t.rlike(_NUMBER_RE), t.try_cast("double"))


def safe_int(c) -> Column:
    """``int(float(x))``: truncation toward zero as bigint, or null (NUM-2; null beyond 64 bits)."""
    d = safe_float(c)
    return F.when(d.isNotNull() & (F.abs(d) < 2.0 ** 63), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("bigint"))


def to_numeric(c) -> Column:
    """``to_numeric(errors='coerce')`` for text or numbers (NUM-3)."""
    return safe_float(_c(c).cast("string"))


def rnd(c, digits: int = 6) -> Column:
    """Fixed-digit rounding as ``round(x * 10^d) / 10^d``.

    Rounding the scaled double (not its decimal string) gives the same double as any
    other engine that rounds half away from zero, so results compare exactly.
    """
    f = float(10 ** digits)
    return F.round(_c(c).cast("double") * f, 0) / f


def round2(c) -> Column:
    """Stored weekly values are rounded half-up to two decimals (NUM-4)."""
    return F.round(_c(c), 2)


def fmt_es(c, decimals: int = 2) -> Column:
    """Spanish number text ``1.234,56``; null gives '' (FMT-1)."""
    return F.coalesce(F.translate(F.format_number(_c(c).cast("double"), decimals), ",.", ".,"), F.lit(""))


def fmt_money(c) -> Column:
    """``$`` + Spanish number; null gives '' (FMT-2)."""
    return F.when(_c(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("$"), fmt_es(c)))


def fmt_pct(c) -> Column:
    """Spanish number + ``%``; null gives '' (FMT-2)."""
    return F.when(_c(c).isNull(), F.lit("")).otherwise(F.concat(fmt_es(c), F.lit("%")))


def fmt_int(c) -> Column:
    """Integer text (truncated); null gives '' (FMT-2)."""
    d = _c(c).cast("double")
    return F.coalesce(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("bigint").cast("string"), F.lit(""))


FORMATTERS = {"money": fmt_money, "pct": fmt_pct, "int": fmt_int, "float": fmt_es}


def format_columns(df, kinds: dict[str, str] | None = None, default: str = "float"):
    """Format every numeric column of ``df`` as text (FMT-3 / FMT-4), one ``select``."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    cols = []
    for f in df.schema.fields:
        kind = (kinds or {}).get(f.name)
        if kind is None and (f.dataType.simpleString() in numeric or f.dataType.simpleString().startswith("decimal")):
            kind = default
        cols.append(FORMATTERS[kind](F.col(f.name)).alias(f.name) if kind else F.col(f.name))
    return df.select(*cols)


def parse_day(c) -> Column:
    """Day-first ``d-m-yyyy`` text to date; invalid gives null (DT-1)."""
    return F.try_to_date(strip_ws(c), "d-M-yyyy")


def day_text(c) -> Column:
    """Date to ``dd-MM-yyyy`` (DT-2)."""
    return F.date_format(_c(c), "dd-MM-yyyy")


def ts_text(c) -> Column:
    """Timestamp to ``dd-MM-yyyy HH:mm`` (DT-2)."""
    return F.date_format(_c(c), "dd-MM-yyyy HH:mm")


def iso_week(c) -> Column:
    """ISO week number (DT-3)."""
    return F.weekofyear(_c(c))


def iso_year(c) -> Column:
    """ISO week-numbering year (DT-3); the reference's calendar-year form is ``F.year``."""
    return F.extract(F.lit("YEAROFWEEK"), _c(c))


def week_fallback_date(week, base: str = WEEK_FALLBACK_BASE) -> Column:
    """``base + (week - 1)`` weeks (DT-5); null for a week outside ``WEEK_RANGE``."""
    w = F.when(_c(week).between(*WEEK_RANGE), _c(week).cast("int"))
    return F.date_add(F.lit(base).cast("date"), (w - 1) * 7)


def in_range(c) -> Column:
    """Whether a number can be stored and summed; null for null."""
    return F.abs(_c(c)) < LARGEST


def week_key(year, week) -> Column:
    """Running key ``year * 100 + week`` (DT-7)."""
    return _c(year) * 100 + _c(week)


def is_date_header(name: str) -> bool:
    """Date-column discovery on header names (SCH-2), evaluated on the driver over column names."""
    return re.match(DATE_HEADER_PATTERN, str(name)) is not None


def sort_date_headers(names: list[str]) -> list[str]:
    """Chronological order of ``d-m-yyyy`` headers; unparseable ones last, stable (DT-6)."""
    import datetime as _dt

    def key(n):
        try:
            d, m, y = (int(x) for x in n.split("-"))
            return (0, _dt.date(y, m, d), "")
        except Exception:
            return (1, _dt.date.min, n)
    return sorted(names, key=key)


def map_value(c, mapping: dict, default) -> Column:
    """Value to symbol through a literal map with a default (MAP-1)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c).cast("string")), F.lit(default))


def json_or_default(c, schema: str, default) -> Column:
    """Parse a JSON config value, falling back to a default (JSON-1)."""
    return F.coalesce(F.from_json(_c(c), schema), default)


def to_json_value(*cols) -> Column:
    """Write a config value as JSON text (JSON-2)."""
    return F.to_json(F.struct(*cols))
