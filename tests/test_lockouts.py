"""Lock-outs by composed chunk functions against the rule applied attempt by attempt."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekcraft.streaming import lockouts as L

MINUTE = 60_000_000


def rule(ts, ok, count=0, until=L.FREE):
    """(attempts that block, count, until): one attempt after the other."""
    out = []
    for i, (t, good) in enumerate(zip(ts, ok, strict=True)):
        if until != L.FREE and t < until:
            continue
        count, until = (0, L.FREE) if good else (count + 1, L.FREE)
        if count == L.MAX_FAILURES:
            count, until = 0, int(t) + L.BLOCK
            out.append(i)
    return out, count, until


def random_attempts(rng, n):
    step = rng.choice([0, 1000, 20_000_000, MINUTE, 4 * MINUTE, 5 * MINUTE, 60 * MINUTE], size=n, p=[.2, .2, .2, .2, .1, .05, .05])
    return np.cumsum(step) + 1, rng.random(n) < rng.choice([0.0, 0.05, 0.3, 0.9])


@pytest.mark.parametrize("seed", range(60))
def test_any_cut_gives_the_same_blocks(seed):
    rng = np.random.default_rng(seed)
    ts, ok = random_attempts(rng, int(rng.integers(1, 200)))
    want, end_count, end_until = rule(ts, ok)
    cuts = np.unique(np.r_[0, rng.integers(0, len(ts), rng.integers(0, 12)), len(ts)])
    chunks = [L.Chunk(ts[a:b], ok[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    functions = [c.function() for c in chunks]
    # Composed in groups, then the groups, and passed down again.
    groups = [functions[i:i + 3] for i in range(0, len(functions), 3)]
    state, got = (np.array([0]), np.array([L.FREE])), []
    at = 0
    for g in groups:
        inner = state
        for f in g:
            got += [int(cuts[at] + i) for i in chunks[at].blocks(int(inner[0][0]), int(inner[1][0]))]
            inner = L.through(f, *inner)
            at += 1
        state = L.through(L.composed(g), *state)
        same = inner[0][0] == state[0][0] and inner[1][0] == state[1][0]
        assert same
    assert got == want
    live = end_until != L.FREE and end_until > ts[-1]
    assert int(state[0][0]) == end_count and (not live or int(state[1][0]) == end_until)


@pytest.mark.parametrize("seed", range(40))
def test_functions_hold_for_every_state(seed):
    rng = np.random.default_rng(1000 + seed)
    ts, ok = random_attempts(rng, int(rng.integers(1, 60)))
    parts = [L.Chunk(t, o).function() for t, o in zip(np.array_split(ts, 3), np.array_split(ok, 3), strict=True) if len(t)]
    whole = L.composed(parts)
    states = [(c, L.FREE) for c in range(L.MAX_FAILURES)] + [(0, int(ts[0]) + d) for d in (-MINUTE, 0, 1, MINUTE, 3 * MINUTE, L.BLOCK - 1)] + [
        (0, int(t)) for t in ts if t < ts[0] + L.BLOCK]
    for count, until in states:
        blocks, c, u = rule(ts, ok, count, until)
        assert L.Chunk(ts, ok).blocks(count, until).tolist() == blocks
        got = L.through(whole, np.array([count]), np.array([until]))
        assert int(got[0][0]) == c
        assert max(int(got[1][0]), int(ts[-1])) == max(u, int(ts[-1]))  # a block that is over is as none


def test_one_user_of_many_failures_over_many_tasks(spark):
    n = 1_000_000
    rng = np.random.default_rng(4)
    ts = np.cumsum(rng.integers(0, 30_000_000, n))
    ok = rng.random(n) < 0.02
    rows = pd.DataFrame({"user_id": 7, "ts": ts.view("datetime64[us]"), "event_id": np.arange(n), "event_type": np.where(ok, "signup", "error")})
    few = pd.DataFrame({"user_id": [1, 1, 2], "ts": ts[:3].view("datetime64[us]"), "event_id": [n, n + 1, n + 2], "event_type": "error"})
    events = spark.createDataFrame(pd.concat([rows, few])).repartition(8)
    want = [(7, int(i)) for i in rule(ts, ok)[0]]
    got = L.lockouts(events, chunk=2000, fan=8).select("user_id", "attempt_no").orderBy("attempt_no").collect()
    assert [tuple(r) for r in got] == want and len(want) > 10_000
    tasks = L.attempt_chunks(L.attempts(events), 2000).filter("user_id = 7").select(F.spark_partition_id()).distinct().count()
    assert tasks > 2  # range partitions split the user


def test_ties_nulls_and_empty(spark):
    schema = "user_id long, ts timestamp_ntz, event_id long, event_type string"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, i, "error") for i in range(12)] + [(None, t, 90, "error"), (1, None, 91, "error"), (1, t + dt.timedelta(minutes=5), 92, "signup"), (1, t, 93, "click")]
    got = L.lockouts(spark.createDataFrame(rows, schema)).collect()
    assert [(r["user_id"], r["blocked_at"], r["attempt_no"]) for r in got] == [(1, t, 4)]
    assert L.lockouts(spark.createDataFrame([], schema)).count() == 0
