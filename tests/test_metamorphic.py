"""Metamorphic and property checks: rank equivalence, upsert idempotence, tenant isolation,
reshape round trips, sessions and lock-outs against brute force."""

import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from weekcraft.operators.merge import upsert
from weekcraft.operators.rank import global_rank, global_ranks, window_rank
from weekcraft.operators.reshape import unpivot_measures
from weekcraft.operators.security import secure
from weekcraft.plans import daily as D
from weekcraft.sources import bindings as B


def test_two_phase_rank_equals_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, 1.0, 2.5, 2.5, 3.0, float(rnd.randint(0, 40))]), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, v double, g int")
    w = Window.orderBy(F.col("v").desc_nulls_last())
    exp = {r.id: r.r for r in df.select("id", F.rank().over(w).alias("r")).collect()}
    got = {r.id: r.r for r in global_rank(df, "v", "r", buckets=5).collect()}
    assert got == exp
    wg = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    exp_g = {r.id: r.r for r in df.select("id", F.rank().over(wg).alias("r")).collect()}
    got_g = {r.id: r.r for r in window_rank(df, "v", "r", ["g"]).collect()}
    assert got_g == exp_g
    kept = {r.id: r.r for r in global_ranks(df, [("v", "r")], keep_null=True, buckets=3).collect()}
    assert kept == {i: (None if v is None else exp[i]) for i, v, _ in rows}


def test_upsert_idempotent_and_order_free(spark, tables):
    raw = B.daily(tables)
    target = D.dedupe_daily(raw.filter(F.col("row_no") % 2 == 0)).drop("row_no")
    batch = raw.filter(F.col("row_no") % 2 == 1)
    rules = {"company_id": "keep", "category": "keep", "value": "new"}
    once = upsert(target, batch, D.DAILY_KEY, rules, order_col="row_no")
    twice = upsert(once, batch, D.DAILY_KEY, rules, order_col="row_no")
    shuffled = upsert(target, batch.repartition(7), D.DAILY_KEY, rules, order_col="row_no", partition_col="day")
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.select(*once.columns).collect()))
    assert a == sorted(map(tuple, shuffled.select(*once.columns).collect()))


def test_security_union_of_users_is_admin(spark, tables):
    d = D.daily_table(tables)
    g = B.grants(tables)
    users = [r.user_id for r in B.users(tables).collect()]
    union = None
    for u in users:
        s = secure(d, g, u)
        union = s if union is None else union.unionByName(s)
    admin = secure(d, g, None, is_admin=True)
    assert sorted(map(tuple, union.collect())) == sorted(map(tuple, admin.collect()))
    assert secure(d, g, None).count() == 0


def test_unpivot_pivot_round_trip(spark, tables):
    w = B.weekly(tables).select("site_id", "run_week", "fat", "prod", "margin")
    long = unpivot_measures(w, ["site_id", "run_week"], [("fat", "fat"), ("prod", "prod"), ("margin", "margin")])
    back = long.groupBy("site_id", "run_week").pivot("concept", ["fat", "prod", "margin"]).agg(F.first("total"))
    a = sorted(map(tuple, w.collect()))
    b = sorted(map(tuple, back.select("site_id", "run_week", "fat", "prod", "margin").collect()))
    assert a == b


def _py_sessions(events, gap):
    out = []
    for uid, g in events.groupby("user_id"):
        ts = sorted(g["ts"])
        start = prev = ts[0]
        n = 1
        for t in ts[1:]:
            if t - prev > pd.Timedelta(minutes=gap):
                out.append((uid, start, prev, n))
                start, n = t, 0
            prev = t
            n += 1
        out.append((uid, start, prev, n))
    return sorted(out)


def test_sessions_against_brute_force(spark, tables):
    from weekcraft.streaming.sessions import sessions
    e = tables.events.select("user_id", "ts")
    pdf = e.toPandas()
    for gap in (60, 360):
        got = sorted((r.user_id, pd.Timestamp(r.session_start), pd.Timestamp(r.session_end), r.n_events)
                     for r in sessions(e, gap).collect())
        assert got == _py_sessions(pdf, gap)


def _py_lockouts(pdf):
    out = []
    for uid, g in pdf.groupby("user_id"):
        count, until = 0, None
        for r in g.sort_values(["ts", "event_id"]).itertuples():
            if until is not None and r.ts < until:
                continue
            if r.event_type == "signup":
                count, until = 0, None
            elif r.event_type == "error":
                count += 1
                if count >= 5:
                    until = r.ts + pd.Timedelta(minutes=5)
                    out.append((uid, r.ts, until))
                    count = 0
    return sorted(out)


def test_lockouts_against_brute_force(spark):
    from weekcraft.sources.tables import Tables
    from weekcraft.streaming.lockouts import lockouts
    ev = Tables(spark, "/root/testdata/sf0.01").events
    got = sorted((r.user_id, pd.Timestamp(r.blocked_at), pd.Timestamp(r.blocked_until)) for r in lockouts(ev).collect())
    exp = _py_lockouts(ev.select("user_id", "ts", "event_id", "event_type").toPandas())
    assert got == exp and len(got) > 0


def test_matrix_independent_of_input_order(spark):
    """Row-order independence: a reshuffled lineitem gives the identical matrix."""
    from weekcraft.plans import matrix as M
    from weekcraft.sources.tables import Tables
    a = Tables(spark, "/root/testdata/sf0.001")
    b = Tables(spark, "/root/testdata/sf0.001")
    b._frames["lineitem"] = b.lineitem.repartition(7, "l_orderkey").sortWithinPartitions(F.rand(3))
    ra = sorted(map(tuple, M.weekly_matrix(a).collect()))
    rb = sorted(map(tuple, M.weekly_matrix(b).collect()))
    assert ra == rb


def test_two_phase_rank_many_buckets_both_directions(spark):
    rnd = random.Random(11)
    rows = [(i, None if i % 17 == 0 else float(rnd.randint(0, 300)) / 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, v double")
    for desc in (True, False):
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
        exp = {r.id: r.r for r in df.select("id", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
        got = {r.id: r.r for r in global_rank(df, "v", "r", descending=desc, buckets=97).collect()}
        assert got == exp


def test_sessions_chain_across_days(spark):
    """Sessions that continue over several midnights, single-partial days in the middle of a
    chain, and days with several partials — all against brute force."""
    import datetime as dt
    from weekcraft.streaming.sessions import sessions
    t0 = dt.datetime(2024, 1, 1, 20, 0)
    rows = [(1, t0 + dt.timedelta(minutes=50 * i)) for i in range(90)]            # ~3 days nonstop
    rows += [(2, dt.datetime(2024, 1, d, 23, 40)) for d in range(1, 6)]          # one event a day
    rows += [(2, dt.datetime(2024, 1, d, 0, 20)) for d in range(2, 7)]           # just after midnight
    rows += [(3, dt.datetime(2024, 1, 3, h, 0)) for h in (1, 5, 9, 23)] + [(3, dt.datetime(2024, 1, 4, 0, 30))]
    rows += [(4, dt.datetime(2024, 1, 10, 12, 0)), (4, dt.datetime(2024, 1, 10, 13, 0))]  # gap exactly 60
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    pdf = df.toPandas()
    for gap in (60, 360):
        got = sorted((r.user_id, pd.Timestamp(r.session_start), pd.Timestamp(r.session_end), r.n_events)
                     for r in sessions(df, gap).collect())
        assert got == _py_sessions(pdf, gap)


def test_lockouts_tricky_sequences(spark):
    """Successes inside a block are ignored (so they are not reset points), a success right
    at block expiry resets, equal timestamps order by event id, counts carry over midnight."""
    import datetime as dt
    from weekcraft.streaming.lockouts import lockouts
    base = dt.datetime(2024, 1, 1, 23, 50)
    ev = []
    eid = 0

    def add(user, minutes, kind):
        nonlocal eid
        eid += 1
        ev.append((eid, base + dt.timedelta(minutes=minutes), user, kind))
    for m in (0, 1, 2, 3, 4):        # user 1: block at 23:54 until 23:59
        add(1, m, "error")
    add(1, 6, "signup")               # inside the block: ignored
    for m in (7, 8, 9):                # ignored too (still blocked until 23:59)
        add(1, m, "error")
    add(1, 9, "signup")               # at 23:59 = block end: effective reset
    for m in (20, 21, 22, 23, 24):     # after midnight: a new block
        add(1, m, "error")
    for m in (0, 0, 0, 0):            # user 2: four failures at the same instant ...
        add(2, m, "error")
    add(2, 0, "signup")               # ... then a success with the same timestamp resets
    for m in (30, 31, 32, 33):        # four more: no block
        add(2, m, "error")
    add(2, 400, "error")              # fifth counted failure hours later (over midnight): block
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    got = sorted((r.user_id, pd.Timestamp(r.blocked_at)) for r in lockouts(df).collect())
    exp = sorted((u, t) for u, t, _ in _py_lockouts(df.toPandas()))
    assert got == exp and len(exp) == 3
