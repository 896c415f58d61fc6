"""The history as a stored fact, one partition per running week (SRC-7, SRC-8, SRC-9, FLT-6).

The facts of a week are aggregated once and kept in the partition of their week; reads name weeks, by a constant or by a join
with a frame of weeks, so the scan lists and reads only those partitions. ``refresh`` rewrites the weeks that new source rows
fall into and no others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcraft.session import path_exists, scratch_path
from weekcraft.sources import bindings as B
from weekcraft.sources.tables import Tables

SCHEMA = ("day date, site_id long, site string, company_id int, margin double, weight long, prod double, price double, cost double, herd long, week int")
_stores: dict[tuple[str, str], str] = {}


def history_rows(t: Tables, lineitem: DataFrame | None = None) -> DataFrame:
    """The history's rows in the store's columns, of all weeks or of those of ``lineitem``."""
    names = B.sites(t).select("site_id", F.col("name").alias("site"))
    return B.weekly(t, lineitem).withColumnsRenamed({"week": "_iso", "run_week": "week", "period_end": "day"}).join(names, "site_id").select(
        *[f.split()[0] for f in SCHEMA.split(", ")])


def write_weeks(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the weeks in ``rows``: one file per week and writing task, the others untouched."""
    rows.repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)


def refresh(t: Tables, path: str, first: int, last: int) -> None:
    """Aggregate the weeks [first, last] anew; only their source rows are read, only their partitions written."""
    write_weeks(history_rows(t, B.lineitem_for_weeks(t, first, last)), path)


def stored_history(spark: SparkSession, t: Tables, sf_dir: str) -> DataFrame:
    """The store of these tables, built below the checkpoint folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores or not path_exists(spark, _stores[key]):
        path = scratch_path(spark, "history-store")
        write_weeks(history_rows(t), path)
        _stores[key] = path
    return read_store(spark, _stores[key])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def weeks_before(hist: DataFrame, weeks: int) -> DataFrame:
    """(week): the ``weeks`` weeks before the latest one, from week 1 on (the latest is found in the partition names).

    The comparison is what makes Spark prune partitions by a join with this frame.
    """
    last = hist.agg(F.max("week").alias("last")).filter(F.col("last").isNotNull())
    return last.select(F.explode(F.sequence(F.col("last") - weeks, F.col("last") - 1)).alias("week")).filter(F.col("week") >= 1)


def since(hist: DataFrame, day: dt.date) -> DataFrame:
    """Rows whose closing day is ``day`` or later: by week first, which prunes, then by day."""
    week = (day - dt.date.fromisoformat(B.WEEK_EPOCH)).days // 7 + 1
    return hist.filter((F.col("week") >= week) & (F.col("day") >= F.lit(day)))
