"""Tenant row security as a query operator (SEC-1..4, JOIN-10, JOIN-11).

The user context is an explicit argument of every call (never session state), and an
unset user sees nothing. The policy is a left-semi join with the user's grants, placed
first so Catalyst pushes it down; grants of one user are bounded by the number of
companies, so the filtered grants side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def secure(df: DataFrame, grants: DataFrame, user_id: int | None, is_admin: bool = False,
           company_col: str = "company_id") -> DataFrame:
    """Rows whose company is granted to ``user_id``; all rows for an admin; none without a user."""
    if is_admin:
        return df
    if user_id is None:
        return df.limit(0)
    mine = grants.filter(F.col("user_id") == F.lit(user_id)).select(F.col("company_id").alias("_gc")).distinct()
    return df.join(mine, F.col(company_col) == F.col("_gc"), "left_semi")


def visible_sites(sites: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, site_id, name) for every active user (SEC-3 through JOIN-11)."""
    active = users.filter(F.col("active")).select("user_id")
    g = grants.join(active, "user_id", "left_semi")
    return g.join(sites, "company_id").select("user_id", "site_id", "name", "company_id")
