"""Trailing-window operators (WIN-4..7).

All windows are partitioned by site (or by key), and the history is keyed by
(week, site), so one window partition holds at most one row per week: the group size is
bounded by the number of weeks, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcraft.operators.aggregates import as_exact, dec_avg_sql


def _exact(total: str) -> str:
    return f"CAST({total} AS DOUBLE)"


def trailing_actual(hist: DataFrame, site_col: str = "site", week_col: str = "week",
                    value_cols: tuple[str, ...] = ("margin", "weight"),
                    spans: tuple[int, ...] = (4, 52)) -> DataFrame:
    """Per site, means over the last n weeks anchored at the site's own latest week (WIN-4).

    Weeks in ``[max-n+1, max]``; the mean is over the rows actually present (non-null
    values). The max includes rows whose values are null. One window (max per site) and
    one aggregate on the same key: a single shuffle.
    """
    h = hist.selectExpr(site_col, week_col, *value_cols, f"max({week_col}) OVER (PARTITION BY {site_col}) AS _mx")
    aggs = [F.expr(f"{dec_avg_sql(f'CASE WHEN {week_col} >= _mx - {n - 1} THEN CAST({c} AS DOUBLE) END')}"
                   f" AS {c}_{n}w") for n in spans for c in value_cols]
    return h.groupBy(site_col).agg(F.expr("max(_mx) AS last_week"), *aggs)


def trailing_fixed(hist: DataFrame, site_col: str = "site", day_col: str = "day",
                   value_cols: tuple[str, ...] = ("margin", "weight"),
                   spans: tuple[int, ...] = (4, 52), week_col: str = "week") -> DataFrame:
    """For every history row, SUM/n over the last n rows of earlier days (WIN-5).

    Nulls add 0; with no earlier row the result is null. Rows of one day are not before each other: each
    takes what the first of them (by week) sees in its ROWS frame. Both windows need the site's rows
    together, so there is one shuffle.
    """
    frames, firsts = [], []
    for n in spans:
        w = f"(PARTITION BY {site_col} ORDER BY {day_col}, {week_col} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for c in value_cols:
            frames.append(f"CASE WHEN count(1) OVER {w} > 0 THEN coalesce({_exact(f'sum({as_exact(c)}) OVER {w}')}, 0.0D) / {n} END AS _{c}_{n}f")
            firsts.append(f"first_value(_{c}_{n}f) OVER (PARTITION BY {site_col}, {day_col} ORDER BY {week_col}) AS {c}_{n}f")
    return hist.selectExpr("*", *frames).selectExpr(*[f"`{c}`" for c in hist.columns], *firsts)


def trailing_series(hist: DataFrame, site_col: str = "site", week_col: str = "week",
                    value_cols: tuple[str, ...] = ("margin", "weight"),
                    spans: tuple[int, ...] = (4, 52)) -> DataFrame:
    """Rolling n-week mean at every week: RANGE frame ``[week-n+1, week]`` (WIN-6)."""
    exprs = []
    for n in spans:
        w = f"(PARTITION BY {site_col} ORDER BY {week_col} RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for c in value_cols:
            total = _exact(f"sum({as_exact(c)}) OVER {w}")
            exprs.append(f"CASE WHEN count({c}) OVER {w} > 0 THEN {total} / count({c}) OVER {w} END AS {c}_{n}w")
    return hist.selectExpr("*", *exprs)


def last_write_wins(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Keep the last row per key inside a batch (WIN-7).

    ``max_by`` over a struct is a plain hash aggregate with map-side partial aggregation,
    so a hot key is reduced before the shuffle (a row_number window would send every row
    of the key to one task).
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.max_by(packed, F.col(order_col)).alias("_last"))
              .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others]))
