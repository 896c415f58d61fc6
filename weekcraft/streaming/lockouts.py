"""Login lock-outs (STM-3): 5 counted failures block the user for 5 minutes; a success
clears the count; attempts while blocked are refused and not counted.

The rule is a state machine per user: how many failures count, and until when the user is blocked (a blocked user has
no counted failures). Batch, exact for any cut of a user's attempts:

1. attempts are sorted by (user, time, id) over range partitions, which split a busy user, and cut into chunks of at
   most ``CHUNK`` attempts of one user, written once;
2. a chunk is a function of the state it is entered with: of each count, and of each attempt within five minutes of its
   first at which a block that came before may end. Its values come from arrays: from an attempt at which nothing is
   counted, the next success or the fifth failure decides the next such attempt, and doubling these steps leads to the end;
3. functions of ``FAN`` consecutive chunks are composed to one, and so on until a user has one; then the state in which
   each chunk is entered is passed down the same way. A composed function has no more values than the user has
   attempts in the first five minutes it covers;
4. each chunk gives the blocks on its path.

Where no user has more than one chunk, step 3 has nothing to do. Stream (``lockout_stream``): event-time timers, the same
walk over the attempts that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weekcraft.session import materialize

# Fixed values that must equal the reference's rule.
MAX_FAILURES = 5
BLOCK_MINUTES = 5

CHUNK, FAN = 8192, 64
#: In microseconds: the length of a block; no block; the block that was there on entry.
BLOCK, FREE, KEPT = BLOCK_MINUTES * 60_000_000, -1, -2

OUT_SCHEMA = "user_id long, blocked_at timestamp_ntz, blocked_until timestamp_ntz, attempt_no long"


def attempts(events: DataFrame, failure: str = "error", success: str = "signup") -> DataFrame:
    """Login attempts from the event log: failures and successes only."""
    return (events.filter(F.col("event_type").isin(failure, success))
                  .select("user_id", "ts", "event_id", (F.col("event_type") == success).alias("success")))


# --- one chunk -----------------------------------------------------------------------------

class Chunk:
    """The path of the rule through consecutive attempts of one user, from every attempt at which nothing is counted."""

    def __init__(self, ts: np.ndarray, ok: np.ndarray):
        n = len(ts)
        self.ts, self.n, at = ts, n, np.arange(n)
        reset = np.where(ok, at, n)
        self.reset = np.minimum.accumulate(reset[::-1])[::-1]  # the next success
        last = at + MAX_FAILURES - 1
        cleared = (self.reset <= last) & (self.reset < n)
        blocks = ~cleared & (last < n)
        self.block = np.where(blocks, np.minimum(last, n - 1), -1)
        until = ts[self.block] + BLOCK
        self.next = np.where(cleared, self.reset + 1, np.where(blocks, np.searchsorted(ts, until), n))
        # The state after the last attempt, for the last step of a path.
        self.count = np.where(cleared | blocks, 0, n - at)
        self.until = np.where(blocks, until, FREE)

    def enter(self, count: int, until: int) -> tuple[int, int, int, int]:
        """(attempt at which nothing is counted, block before it, count and block at the end if there is none)."""
        if until != FREE:
            return int(np.searchsorted(self.ts, until)), -1, 0, until
        last = MAX_FAILURES - 1 - count
        first = int(self.reset[0]) if self.n else self.n
        if first <= last and first < self.n:
            return first + 1, -1, 0, FREE
        if last < self.n:
            until = int(self.ts[last]) + BLOCK
            return int(np.searchsorted(self.ts, until)), last, 0, until
        return self.n, -1, count + self.n, FREE

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(count, block) after the last attempt, for every attempt at which nothing is counted."""
        last = np.where(self.next < self.n, self.next, np.arange(self.n))
        while True:
            further = last[last]
            if (further == last).all():
                return self.count[last], self.until[last]
            last = further

    def function(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(times of the first attempts, counts, blocks): values for the entered counts, then for blocks that end at the first attempts or after them."""
        near = int(np.searchsorted(self.ts, self.ts[0] + BLOCK))
        end_count, end_until = self.ends()
        count, until = [], []
        for c in range(MAX_FAILURES):
            start, _, k, u = self.enter(c, FREE)
            count.append(end_count[start] if start < self.n else k)
            until.append(end_until[start] if start < self.n else u)
        beyond = [(end_count[near], end_until[near])] if near < self.n else [(0, KEPT)]
        return (self.ts[:near], np.r_[count, end_count[:near], [b[0] for b in beyond]].astype(np.int64),
                np.r_[until, end_until[:near], [b[1] for b in beyond]].astype(np.int64))

    def blocks(self, count: int, until: int) -> np.ndarray:
        """Attempts that block, on the path from this state."""
        start, block, *_ = self.enter(count, until)
        met, step = np.array([start] if start < self.n else [], dtype=np.int64), np.r_[self.next, self.n]
        while len(met):
            more = step[met]
            more = more[more < self.n]
            if not len(more):
                break
            met, step = np.r_[met, more], step[step]
        found = self.block[met]
        return np.sort(np.r_[found[found >= 0], [block] if block >= 0 else []].astype(np.int64))


def through(function: tuple[np.ndarray, np.ndarray, np.ndarray], count: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after a function, from states before it."""
    starts, counts, untils = function
    at = np.where(until != FREE, MAX_FAILURES + np.searchsorted(starts, until), count)
    return counts[at], np.where(untils[at] == KEPT, until, untils[at])


def composed(functions: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One function for consecutive ones."""
    end = functions[0][0][0] + BLOCK
    starts = np.concatenate([s[:np.searchsorted(s, end)] for s, _, _ in functions])
    count = np.r_[np.arange(MAX_FAILURES), np.zeros(len(starts) + 1, dtype=np.int64)]
    until = np.r_[np.full(MAX_FAILURES, FREE), starts, end]
    still = np.r_[np.zeros(MAX_FAILURES + len(starts), dtype=bool), True]  # the block on entry has not ended yet
    for f in functions:
        still &= f[2][np.where(until != FREE, MAX_FAILURES + np.searchsorted(f[0], until), count)] == KEPT
        count, until = through(f, count, until)
    return starts, count, np.where(still, KEPT, until)


# --- all users -----------------------------------------------------------------------------

CHUNKS = "user_id long, chunk long, ts array<timestamp_ntz>, event_id array<long>, success array<boolean>"
FUNCTIONS = "user_id long, place long, starts array<long>, counts array<long>, untils array<long>"
STATES = "user_id long, place long, count long, until long"


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "timestamp_ntz": pa.timestamp("us"), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()),
             "array<timestamp_ntz>": pa.list_(pa.timestamp("us"))}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def attempt_chunks(att: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of at most ``chunk`` attempts of one user in order; ``chunk`` numbers ascend with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            user, ts, eid, ok = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero(user[1:] != user[:-1]) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(user)], strict=True):
                part = [ts[a:b], eid[a:b], ok[a:b]]
                if held is not None and held[0] != user[a]:
                    yield _rows(CHUNKS, [[held[0]], [number], *([x] for x in held[1])])
                    number, held = number + 1, None
                if held is not None:
                    part = [np.concatenate(x) for x in zip(held[1], part, strict=True)]
                while len(part[0]) > chunk:
                    yield _rows(CHUNKS, [[user[a]], [number], *([x[:chunk]] for x in part)])
                    number, part = number + 1, [x[chunk:] for x in part]
                held = (user[a], part)
        if held is not None:
            yield _rows(CHUNKS, [[held[0]], [number], *([x] for x in held[1])])

    parts = int(att.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = ["user_id", "ts", "event_id"]
    return (att.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("user_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("event_id").cast("long"), "success")
            .repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, CHUNKS))


def _micros(array: pa.Array) -> np.ndarray:
    return array.cast(pa.int64()).to_numpy(zero_copy_only=False)


def chunk_functions(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for user, place, ts, ok in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                f = Chunk(_micros(ts.values), ok.values.to_numpy(zero_copy_only=False)).function()
                yield _rows(FUNCTIONS, [[user], [place], *([x] for x in f)])

    return chunks.select("user_id", "place", "ts", "success").mapInArrow(run, FUNCTIONS)


def _functions(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    order = np.argsort(table.column("place").to_numpy())
    lists = [table.column(c).combine_chunks() for c in ("starts", "counts", "untils")]
    return [tuple(x[int(i)].values.to_numpy() for x in lists) for i in order]


def compose(functions: DataFrame, fan: int) -> DataFrame:
    """One function for every ``fan`` consecutive places of a user."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        f = composed(_functions(table))
        return pa.Table.from_batches([_rows(FUNCTIONS, [[key[0].as_py()], [key[1].as_py()], *([x] for x in f)])])

    return functions.groupBy("user_id", F.expr(f"place div {fan}").alias("up")).applyInArrow(run, FUNCTIONS)


def pass_down(functions: DataFrame, states: DataFrame, fan: int) -> DataFrame:
    """The state in which every place is entered, from that of its group of ``fan``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, entered: pa.Table) -> pa.Table:
        places = np.sort(table.column("place").to_numpy())
        count, until = (np.array([entered.column(c)[0].as_py()]) for c in ("count", "until"))
        out = []
        for place, f in zip(places, _functions(table), strict=True):
            out.append((key[0].as_py(), int(place), int(count[0]), int(until[0])))
            count, until = through(f, count, until)
        return pa.Table.from_batches([_rows(STATES, list(zip(*out, strict=True)))])

    below = functions.withColumn("_up", F.expr(f"place div {fan}")).groupBy("user_id", "_up")
    above = states.withColumnRenamed("place", "_up").groupBy("user_id", "_up")
    return below.cogroup(above).applyInArrow(run, STATES)


def lockouts(events: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(user_id, blocked_at, blocked_until, attempt_no) of all blocks; attempts without a user or time are passed over."""
    numbered = Window.partitionBy("user_id").orderBy("chunk")
    # Places are numbered over chunks, at most one row per ``chunk`` attempts of a user.
    chunks = materialize(attempt_chunks(attempts(events), chunk), "attempt-chunks")
    places = chunks.select("user_id", "chunk").withColumn("place", (F.row_number().over(numbered) - 1).cast("long"))
    chunks = materialize(chunks.join(places, ["user_id", "chunk"]), "attempt-places")
    most = chunks.agg(F.max("place")).first()[0]
    if not most:
        entered = chunks.withColumns({"count": F.lit(0).cast("long"), "until": F.lit(FREE).cast("long")})
    else:
        levels = [materialize(chunk_functions(chunks.join(chunks.filter("place = 1").select("user_id"), "user_id", "left_semi")), "functions")]
        while most >= fan:
            levels.append(materialize(compose(levels[-1], fan), "functions"))
            most //= fan
        states = levels[-1].select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("count"), F.lit(FREE).cast("long").alias("until"))
        for functions in reversed(levels):
            states = pass_down(functions, states, fan)
        entered = chunks.join(states, ["user_id", "place"], "left").fillna({"count": 0, "until": FREE})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for user, ts, eid, ok, count, until in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist(),
                                                       batch.column(5).to_pylist(), strict=True):
                times = _micros(ts.values)
                at = Chunk(times, ok.values.to_numpy(zero_copy_only=False)).blocks(count, until)
                found.append((np.full(len(at), user), times[at], times[at] + BLOCK, eid.values.to_numpy()[at]))
            if found:
                user, start, end, eid = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                yield _rows(OUT_SCHEMA, [user, start.view("datetime64[us]"), end.view("datetime64[us]"), eid])

    return entered.select("user_id", "ts", "event_id", "success", "count", "until").mapInArrow(run, OUT_SCHEMA)


# --- stream --------------------------------------------------------------------------------

def walk(ts: np.ndarray, ok: np.ndarray, count: int, until: int) -> tuple[np.ndarray, int, int]:
    """(attempts that block, count, block) of consecutive attempts of one user entered in this state."""
    chunk = Chunk(ts, ok)
    start, _, end_count, end_until = chunk.enter(count, until)
    if start < chunk.n:
        counts, untils = chunk.ends()
        end_count, end_until = int(counts[start]), int(untils[start])
    return chunk.blocks(count, until), end_count, end_until


class LockoutProcessor(StatefulProcessor):
    """The rule over a stream whose attempts come late and in any order within the watermark's delay.

    State of a user: the attempts that the watermark has not passed, and (count, block, time of the last attempt). A timer is
    set for the latest attempt of a batch; when the watermark passes it, the attempts up to the watermark are walked
    through in order. A user without attempts for ``idle_ms`` after the last one is forgotten.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, success boolean")
        self.rule = handle.getValueState("rule", "count long, until long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            ts = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            self.waiting.appendList(list(zip(ts.tolist(), pdf["event_id"].astype(int).tolist(), pdf["success"].astype(bool).tolist(), strict=True)))
            latest = int(ts.max()) if latest is None else max(latest, int(ts.max()))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= passed]
        count, until, last = self.rule.get() if self.rule.exists() else (0, FREE, -1)
        if due:
            if len(due) < len(rows):
                self.waiting.put(rows[len(due):])
            else:
                self.waiting.clear()
            ts, eid, ok = (np.array(x) for x in zip(*due, strict=True))
            at, count, until = walk(ts, ok.astype(bool), int(count), int(until))
            last = int(ts[-1])
            self.rule.update((count, until, last))
            if len(at):
                yield pd.DataFrame({"user_id": int(key[0]), "blocked_at": ts[at].view("datetime64[us]"), "blocked_until": (ts[at] + BLOCK).view("datetime64[us]"),
                                    "attempt_no": eid[at]})
        if len(due) == len(rows):
            gone = -(-int(last) // 1000) + self.idle_ms
            if gone <= timerValues.getCurrentWatermarkInMs():
                self.rule.clear()
            else:
                self.handle.registerTimer(gone)

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lockout_stream(stream: DataFrame, delay: str = "10 minutes", idle_minutes: int = 60) -> DataFrame:
    """Streaming form: blocks, each once the watermark (``delay`` behind the latest attempt) has passed it.

    Attempts may come in any order within ``delay``; later ones are dropped. After ``idle_minutes`` without an
    attempt a user's counted failures are forgotten, as a session of the reference ends: within that bound the result is that
    of ``lockouts``. The state is kept by RocksDB, which the session is set to.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    att = attempts(stream).filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return (att.withWatermark("ts", delay).groupBy("user_id")
               .transformWithStateInPandas(LockoutProcessor(idle_minutes * 60_000), OUT_SCHEMA, "append", "eventTime"))
