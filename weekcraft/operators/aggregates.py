"""Aggregate building blocks (AGG-1..3, DRV-1..7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_exact(x: str) -> str:
    """A number as DECIMAL(28, 10): sums of it are exact, whatever the order (partitioning, retries, engine)."""
    return f"CAST({x} AS DECIMAL(28, 10))"


def dec_sum(c) -> Column:
    """Exact sum of numbers with up to ten decimal places, as double; no rounding to fewer."""
    return F.sum(_c(c).cast("decimal(28, 10)")).cast("double")


def dec_avg(c) -> Column:
    """Mean of non-null values as exact sum / count (null when none)."""
    n = F.count(_c(c))
    return F.when(n > 0, dec_sum(c) / n)


def dec_parts(c) -> list[Column]:
    """Exact sum ``dec_sum`` and count ``dec_count`` of non-null values, from which ``dec_avg_of_parts`` makes the mean of several groups."""
    return [F.sum(_c(c).cast("decimal(28, 10)")).alias("dec_sum"), F.count(_c(c)).alias("dec_count")]


def dec_avg_of_parts() -> Column:
    """``dec_avg`` over groups that were summed by ``dec_parts``."""
    n = F.sum("dec_count")
    return F.when(n > 0, F.sum("dec_sum").cast("double") / n)


def truthy(c: Column) -> Column:
    """Python truthiness of a number: non-null and non-zero."""
    return c.isNotNull() & (c != 0)


def greens_expr(stored, pasture, green) -> Column:
    """DRV-1: stored greens unless missing or 0, else pasture + green (nulls as 0)."""
    s = F.coalesce(_c(stored), F.lit(0.0))
    return F.when(s == 0, F.coalesce(_c(pasture), F.lit(0.0)) + F.coalesce(_c(green), F.lit(0.0))).otherwise(s)


def total_ms_expr(greens, conserved, concentrate) -> Column:
    """DRV-1: total dry matter = greens + conserved + concentrate (nulls as 0)."""
    return _c(greens) + F.coalesce(_c(conserved), F.lit(0.0)) + F.coalesce(_c(concentrate), F.lit(0.0))


def margin_expr(price, prod, cost) -> Column:
    """DRV-2."""
    return _c(price) * _c(prod) - _c(cost)


def margin_per_litre(price, prod, cost) -> Column:
    """DRV-3: (price*prod - cost)/price; null when any input is null or price is 0."""
    return F.when(_c(prod).isNotNull() & _c(cost).isNotNull() & truthy(_c(price)),
                  margin_expr(price, prod, cost) / _c(price))


def stocking_expr(herd, area) -> Column:
    """DRV-4: herd / area when area > 0 (not coupled to the other measures)."""
    return F.when(_c(area) > 0, _c(herd) / _c(area))


def cost_share(price, prod, cost) -> Column:
    """DRV-5: cost / (price*prod) when all three are non-zero and income > 0."""
    income = _c(price) * _c(prod)
    return F.when(truthy(_c(prod)) & truthy(_c(price)) & truthy(_c(cost)) & (income > 0), _c(cost) / income)


def greens_weekly(pasture, green) -> Column:
    """DRV-7: pasture + green when either is present (nulls as 0)."""
    return F.when(_c(pasture).isNotNull() | _c(green).isNotNull(),
                  F.coalesce(_c(pasture), F.lit(0.0)) + F.coalesce(_c(green), F.lit(0.0)))


# SQL-text twins of the helpers above, for building wide projections/aggregations in one
# JVM call (``selectExpr`` / ``F.expr``) instead of one py4j call per operator.
def dec_sum_sql(x: str) -> str:
    return f"CAST(sum({as_exact(x)}) AS DOUBLE)"


def dec_avg_sql(x: str) -> str:
    return f"CASE WHEN count({x}) > 0 THEN {dec_sum_sql(x)} / count({x}) END"


def weighted_avg_sql(v: str, w: str) -> str:
    """sum(v*w)/sum(w) over rows where v, w are non-null and w != 0; null if none (AGG-2)."""
    ok = f"({v}) IS NOT NULL AND ({w}) IS NOT NULL AND ({w}) != 0"
    num = dec_sum_sql(f"CASE WHEN {ok} THEN CAST({v} AS DOUBLE) * CAST({w} AS DOUBLE) END")
    den = dec_sum_sql(f"CASE WHEN {ok} THEN {w} END")
    return f"CASE WHEN {den} != 0 THEN {num} / {den} END"


def sum0_sql(x: str) -> str:
    return f"coalesce({dec_sum_sql(x)}, 0.0D)"
