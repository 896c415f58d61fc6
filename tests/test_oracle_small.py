"""Every registered query against its DuckDB oracle on the smallest scale (the driver runs
the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from weekcraft.sources.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    from weekcraft.plans.catalog import QUERIES
    from weekcraft.plans.catalog_sql import ORACLE
    assert set(SQL) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    cur = con.execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "is_total" in df.columns
