"""Sessions over time slices: the slices come from the data, and a hot user's day is split."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekcraft.streaming import sessions as S

T0 = dt.datetime(2024, 1, 1, 23, 0)


def plain(rows, gap):
    out = []
    for user in sorted({u for u, _ in rows}):
        times = sorted(t for u, t in rows if u == user)
        start = last = times[0]
        n = 0
        for t in [*times, None]:
            if t is None or t - last > dt.timedelta(minutes=gap):
                out.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
    return sorted(out)


@pytest.mark.parametrize("seconds", [None, 86_400, 600, 7.5, 0.5])
def test_slices_do_not_change_sessions(spark, seconds):
    import random
    rng = random.Random(6)
    rows, t = [], T0
    for _ in range(400):
        t += dt.timedelta(minutes=rng.choice([0, 0, 0.01, 1, 1, 59, 60, 60.001, 61, 300]))
        rows.append((rng.choice([1, 1, 1, 2]), t))
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    for gap in (60, 360):
        got = S.sessions(events, gap, seconds=seconds).collect()
        assert sorted((r["user_id"], r["session_start"], r["session_end"], r["n_events"]) for r in got) == plain(rows, gap)


def test_slices_follow_the_data(spark):
    events = spark.range(100_000).select(F.lit(1).cast("long").alias("user_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 7200)).alias("ts"))
    assert S.slice_seconds(events, most_rows=200_000) == 86_400
    assert S.slice_seconds(events, most_rows=40_000) == 600
    assert S.slice_seconds(events, most_rows=1_000) == 60
    assert S.slice_seconds(events, most_rows=500) == 30
    assert S.slice_seconds(events.limit(0)) == 86_400


def test_a_hot_day_of_one_user_lies_in_several_tasks(spark):
    events = spark.range(50_000).select(F.lit(1).cast("long").alias("user_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 3600)).alias("ts"))
    micros = int(S.slice_seconds(events, most_rows=2_000) * 1e6)
    dealt = events.groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / micros).alias("_slice")).count()
    assert dealt.count() >= 25  # groups of the first exchange, none of over 2000 events
    assert dealt.agg(F.max("count")).first()[0] <= 2_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert dealt.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert S.sessions(events, 60, seconds=micros / 1e6).collect()[0]["n_events"] == 50_000
