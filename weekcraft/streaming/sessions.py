"""Inactivity sessions (STM-2): a session ends after ``gap`` idle minutes; a gap of exactly
``gap`` continues the session (the reference's idle test is strictly greater).

Batch plan, exact, with no per-user step over events or sessions:
1. ``session_window`` inside (user, time slice) groups -> partial sessions (start, end, count). Slices are as short as the
   data ask for: none holds more than about ``SLICE_ROWS`` events, so the events of a user on one day lie in several groups
   where they are many;
2. a carry table with a row per (user, slice) decides whether each slice's first partial continues the last one of the user's
   slice before; the session start in force is carried over slices with a running max (per-user windows over slices only);
3. partials are keyed by their session start and aggregated by (user, key).
The streaming form is the native ``session_window`` aggregation with a watermark.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events of a slice, and the slices to choose from, in seconds: a day, six hours, an hour, ten minutes, a minute.
SLICE_ROWS = 2_000_000
WIDTHS = [86_400, 21_600, 3_600, 600, 60]


def slice_seconds(events: DataFrame, ts_col: str = "ts", most_rows: int = SLICE_ROWS) -> float:
    """The widest slice of ``WIDTHS`` with at most ``most_rows`` events of all users; where a minute holds more, its share.

    Events are counted per minute first (as many rows as the data have minutes), then the minutes per width. No slice
    of a table holds more events than the table, so the widest fits where all events do.
    """
    if events.count() <= most_rows:
        return WIDTHS[0]
    minute = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / 60_000_000)
    per_minute = events.groupBy(minute.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    per_slice = (per_minute.select("_n", "_m", F.explode(F.array(*[F.lit(w) for w in WIDTHS])).alias("_w"))
                 .groupBy("_w", F.floor(F.col("_m") * 60 / F.col("_w")).alias("_at")).agg(F.sum("_n").alias("_n")))
    most = {r["_w"]: r["n"] for r in per_slice.groupBy("_w").agg(F.max("_n").alias("n")).collect()}
    for w in WIDTHS:
        if most.get(w, 0) <= most_rows:
            return w
    return max(0.001, 60 / 2 ** math.ceil(math.log2(most[60] / most_rows)))


def sessions(events: DataFrame, gap_minutes: int, user_col: str = "user_id", ts_col: str = "ts", seconds: float | None = None) -> DataFrame:
    """Sessions of every user; ``seconds`` is the length of a slice, by default that of ``slice_seconds``."""
    gap = f"{gap_minutes} minutes"
    u = user_col
    micros = int((seconds or slice_seconds(events, ts_col)) * 1_000_000)
    # 1. partial sessions inside each (user, slice): maximal within the slice
    at = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / micros).alias("_slice")
    part = (events.groupBy(u, at, F.session_window(ts_col, gap).alias("_sw"))
                  .agg(F.min(ts_col).alias("_s"), F.max(ts_col).alias("_e"), F.count(F.lit(1)).alias("_n")))
    # 2. per (user, slice): does its first partial continue the last partial of the user's slice
    #    before, and which session start ("anchor") is in force at its end.
    #    The per-user windows run over slices only, never over events or sessions.
    slices = part.groupBy(u, "_slice").agg(F.min("_s").alias("_fs"), F.max("_s").alias("_ls"),
                                           F.max("_e").alias("_le"), F.count(F.lit(1)).alias("_np"))
    w = Window.partitionBy(u).orderBy("_slice")
    prev_end = F.lag("_le").over(w)
    cont = prev_end.isNotNull() & (F.col("_fs") <= prev_end + F.expr(f"INTERVAL {gap_minutes} MINUTES"))
    slices = slices.withColumn("_cont", cont)
    anchor = (F.when(F.col("_np") > 1, F.col("_ls"))
               .when(~F.col("_cont"), F.col("_fs")))            # null: a continued slice of one partial
    slices = slices.withColumn("_anchor", anchor)
    inherited = F.max("_anchor").over(w.rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(u, "_slice", "_fs", F.when(F.col("_cont"), inherited).otherwise(F.col("_fs")).alias("_fkey"))
    # 3. every partial gets its session key (its own start, or the inherited start for a
    #    continuing first partial) and sessions are aggregated by (user, key)
    keyed = (part.join(slices, [u, "_slice"])
                 .withColumn("_key", F.when(F.col("_s") == F.col("_fs"), F.col("_fkey")).otherwise(F.col("_s"))))
    return (keyed.groupBy(u, "_key")
                 .agg(F.min("_s").alias("session_start"), F.max("_e").alias("session_end"),
                      F.sum("_n").cast("bigint").alias("n_events"))
                 .select(u, F.lit(gap_minutes).alias("gap_minutes"), "session_start", "session_end", "n_events"))


def session_stream(stream: DataFrame, gap_minutes: int, watermark: str = "2 hours",
                   user_col: str = "user_id", ts_col: str = "ts") -> DataFrame:
    """Streaming sessions: ``session_window`` + watermark (late events within the
    watermark still extend their session; the session is emitted once it closes)."""
    if stream.schema[ts_col].dataType.simpleString() == "timestamp_ntz":
        # watermarks need TIMESTAMP; with the session time zone pinned the instants are unchanged
        stream = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return (stream.withWatermark(ts_col, watermark)
                  .groupBy(user_col, F.session_window(ts_col, f"{gap_minutes} minutes").alias("session"))
                  .agg(F.count(F.lit(1)).alias("n_events"), F.min(ts_col).alias("session_start"),
                       F.max(ts_col).alias("session_end")))
