"""STM-1: a file stream upserting daily facts equals the batch upsert, and replaying the
same files changes nothing. STM-2 streaming sessions run end to end."""

import os
import tempfile

from pyspark.sql import functions as F

from weekcraft.operators.merge import upsert
from weekcraft.plans import daily as D
from weekcraft.sources import bindings as B
from weekcraft.streaming.arrival import RULES, start_daily_arrival


def test_stream_equals_batch_and_is_replay_safe(spark, tables):
    raw = B.daily(tables).select("site_id", "day", "concept", "company_id", "category", "value", "row_no")
    base = tempfile.mkdtemp(prefix="weekcraft-stream-")
    src, table = os.path.join(base, "in"), os.path.join(base, "daily")
    raw.filter(F.col("row_no") % 2 == 0).write.parquet(os.path.join(src, "b1"))
    raw.filter(F.col("row_no") % 2 == 1).write.parquet(os.path.join(src, "b2"))
    q = start_daily_arrival(spark, os.path.join(src, "*"), raw.schema, table, os.path.join(base, "ck1"))
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(table).select("site_id", "day", "concept", "company_id", "category",
                                                              "value").collect()))
    empty = spark.createDataFrame([], raw.drop("row_no").schema)
    exp = upsert(empty, raw, D.DAILY_KEY, RULES, order_col="row_no")
    assert got == sorted(map(tuple, exp.select("site_id", "day", "concept", "company_id", "category", "value")
                             .collect()))
    # replay every file with a fresh checkpoint: same table
    q2 = start_daily_arrival(spark, os.path.join(src, "*"), raw.schema, table, os.path.join(base, "ck2"))
    q2.awaitTermination()
    again = sorted(map(tuple, spark.read.parquet(table).select("site_id", "day", "concept", "company_id", "category",
                                                                "value").collect()))
    assert again == got


def test_session_stream_equals_batch(spark, tables):
    """Once later events move the watermark on, the stream has given all sessions of the batch form."""
    from weekcraft.streaming.sessions import session_stream, sessions
    base = tempfile.mkdtemp(prefix="weekcraft-sess-")
    folder = os.path.join(base, "ev")
    ev = tables.events.select("user_id", "ts")
    ev.coalesce(1).write.parquet(folder)
    for days in (10, 20):
        ev.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.expr(f"ts + INTERVAL {days} DAYS").alias("ts")).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)
    q = (session_stream(stream, 60).writeStream.format("memory").queryName("sess_out").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    columns = "user_id", "CAST(session_start AS TIMESTAMP_NTZ) AS s", "CAST(session_end AS TIMESTAMP_NTZ) AS e", "n_events"
    got = sorted(map(tuple, spark.table("sess_out").filter("user_id >= 0").selectExpr(*columns).collect()))
    assert got == sorted(map(tuple, sessions(ev, 60).selectExpr(*columns).collect())) and got


def test_lockout_stream_equals_batch_for_late_and_shuffled_attempts(spark):
    """Batches that overlap in time, rows of a batch in any order, and users that go idle."""
    import datetime as dt
    import random

    from weekcraft.streaming import lockouts as L
    rng, rows, t = random.Random(3), [], dt.datetime(2024, 1, 1)
    for i in range(600):
        t += dt.timedelta(seconds=rng.choice([0, 5, 20, 60, 240]))
        rows.append((rng.choice([1, 1, 2, 3]), t, i, "signup" if rng.random() < 0.08 else "error"))
    schema = "user_id long, ts timestamp_ntz, event_id long, event_type string"
    base = tempfile.mkdtemp(prefix="weekcraft-lock-")
    # Each attempt goes to the batch of its time or the next one.
    batches = [[] for _ in range(7)]
    for k, r in enumerate(rows):
        batches[min(6, k * 6 // len(rows) + rng.randint(0, 1))].append(r)
    far = t + dt.timedelta(days=2)
    batches += [[(9, far, 10_000, "signup")], [(9, far + dt.timedelta(days=2), 10_001, "signup")], [(9, far + dt.timedelta(days=2, minutes=1), 10_002, "signup")]]
    folder = os.path.join(base, "in")
    for i, b in enumerate(batches):
        rng.shuffle(b)
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (L.lockout_stream(stream, delay="2 days", idle_minutes=24 * 60).writeStream.format("memory").queryName("lock_out").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.sql("SELECT user_id, blocked_at, blocked_until, attempt_no FROM lock_out").collect()))
    want = sorted(map(tuple, L.lockouts(spark.createDataFrame(rows, schema)).collect()))
    assert got == want and len(want) > 20
    # Idle users leave no state: only the user of the last batches may have some.
    state = spark.read.format("statestore").option("stateVarName", "rule").load(os.path.join(base, "ck"))
    left = {r[0] for r in state.select("key.user_id").collect()}
    assert left <= {9}, left
