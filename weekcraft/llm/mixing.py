"""Mixing sources to target weights by balanced sampling with the cube method.

The size of a document is its number of words. Sources by code point, null last, weigh 5, 2, 1,
repeating, and share 150 % of all words; a target stops at twice its source's size, the excess is
shared again by weight until none is above. Every document of a source then has the same expected
number of copies, target / source size: its whole part is taken, and its fraction is the inclusion
probability of one copy more.

The cube method turns the probabilities into 0 or 1. In the flight phase three documents at a time
move along the vector that changes neither the expected number of words nor of documents, by a random
step with zero mean, until one of them is 0 or 1. Documents are dealt by a hash into buckets of
about ``BUCKET`` of one source; two at most stay fractional in each. Those of ``FAN`` buckets meet in a
bucket of the next level, and so on until one bucket per source is left. There the last two land on
the corner that misses the words least, and one or two documents at a time are turned over while that brings the words nearer. So a source of any size is split, every bucket is bounded, and
the words taken of a source miss its target by a few words.

Random steps come from a hash of the documents in the bucket, so reruns agree for any partitioning.
Rows that repeat both id and text are one unit and get the same copies. Null texts have
size 0; a source without words has target 0 and gets no copies. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weekcraft.llm.common import WORD, read_table, text_of
from weekcraft.session import materialize

#: Fixed values of the mix: weights by position of the source, share of all words, most copies.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
BUCKET, FAN = 4096, 1024


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) from (source, size): one row per source.

    A source is capped when the level that the remaining words would give per weight reaches its
    cap; by ascending cap per weight, that is a prefix, so running sums find the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("m").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = per.withColumn("w", w).withColumn("cap", (MOST_COPIES * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / rest).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    # The level of the first source that is not capped holds for it and all that follow.
    final = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level")))).over(every)["level"]
    return level.withColumn("final", final).select(
        "source", "source_size", "docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1 with sum(p) and sum(p * size) unchanged; two at most stay between."""
    p = p.astype(float).copy()
    draws = iter(rng.random(3 * len(p) + 16))
    waiting = [i for i in range(len(p)) if 0 < p[i] < 1]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            i, j, k = active
            u = [size[k] - size[j], size[i] - size[k], size[j] - size[i]]
            if not any(u):
                u = [1, -1, 0]
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = [1, -1]
        else:
            return p
        up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(active, u, strict=True) if d)
        down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(active, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for a, d in zip(active, u, strict=True):
            p[a] += step * d
            if p[a] < 1e-9:
                p[a] = 0.0
            elif p[a] > 1 - 1e-9:
                p[a] = 1.0
            else:
                left.append(a)
        active = left


def land(start: np.ndarray, p: np.ndarray, size: np.ndarray, turns: int = 8) -> np.ndarray:
    """Round the few units that the flight left, then turn over one or two units while that brings the words nearer.

    ``start``: the probabilities before the flight; only units that were fractional there are turned.
    """
    at = np.flatnonzero((p > 0) & (p < 1))
    words = (start * size).sum()
    p = p.copy()
    if len(at):
        others = (p * size).sum() - (p[at] * size[at]).sum()
        p[at] = min(itertools.product((0.0, 1.0), repeat=len(at)), key=lambda x: (round(abs(others + np.dot(x, size[at]) - words), 6), x))
    free = np.flatnonzero((start > 0) & (start < 1))
    for _ in range(turns if len(free) > 1 else 0):
        miss = (p * size).sum() - words
        change = np.where(p[free] > 0, -size[free], size[free])
        order = np.argsort(change, kind="stable")
        ranked = change[order]
        # One unit, or the pair whose changes come nearest to -miss: each unit with the two best partners by rank.
        best = (abs(miss), ())
        one = int(np.abs(miss + change).argmin())
        best = min(best, (abs(miss + change[one]), (one,)))
        at = np.searchsorted(ranked, -miss - change)
        for shift in (-1, 0):
            mate = order[np.clip(at + shift, 0, len(order) - 1)]
            off = np.where(mate == np.arange(len(free)), np.inf, np.abs(miss + change + change[mate]))
            k = int(off.argmin())
            best = min(best, (off[k], (k, int(mate[k]))))
        if best[0] >= abs(miss) - 1e-6:
            break
        for k in best[1]:
            p[free[k]] = 1 - p[free[k]]
    return p


def _level(units: DataFrame, last: bool) -> DataFrame:
    """One flight in every (source, bucket); ``extra`` is 0 or 1, or null for the units that stay fractional."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Largest first: the units that are left to land are small ones.
        rows = (rows.assign(words=rows["size"] * rows["m"]).sort_values(["words", "spot", "doc_id", "hash"], ascending=[False, True, True, True])
                .reset_index(drop=True))
        p, size = rows["p"].to_numpy(), rows.pop("words").to_numpy().astype(float)
        rng = np.random.default_rng(zlib.crc32(rows["spot"].to_numpy().tobytes()))
        start = p
        p = flight(start, size, rng)
        if last:
            p = land(start, p, size)
        rows["p"] = p
        rows["extra"] = pd.array(np.where(p >= 1, 1, 0), dtype="Int32")
        rows.loc[(p > 0) & (p < 1), "extra"] = pd.NA
        return rows

    return units.groupBy("source", "bucket").applyInPandas(run, "source string, doc_id long, hash long, size long, m long, source_size long, target double, "
                                                                "base int, p double, buckets long, bucket long, spot long, extra int")


def mix_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per distinct (id, source, text): doc_id, source, hash, size, m (rows), source_size, target, copies."""
    units = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                    F.xxhash64(text_of(text_col)).alias("hash"), word_count(text_col).alias("size"))
                        .groupBy("doc_id", "source", "hash").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("m")), "mix_units")
    targets = materialize(source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size"), "m")), "mix_targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(ratio, 9)
    base = F.floor(near)
    spot = F.xxhash64("doc_id", "hash", F.lit(17))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET)).cast("long")
    # Sources are few next to documents: AQE broadcasts their table where it is measured small, else splits skewed sources.
    dealt = (units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
             .withColumn("base", base.cast("int")).withColumn("p", near - base)
             .withColumn("buckets", buckets).withColumn("spot", spot).withColumn("bucket", F.pmod(F.col("spot"), F.col("buckets"))).drop("docs"))
    done: list[DataFrame] = [dealt.where(F.col("p") == 0).withColumn("extra", F.lit(0))]
    open_units = dealt.where(F.col("p") > 0)
    most = targets.agg(F.max(F.ceil(F.col("docs") / BUCKET))).first()[0] or 1
    while True:
        last = most <= 1
        flown = materialize(_level(open_units, last), "mix_level")
        done.append(flown.where(F.col("extra").isNotNull()))
        if last:
            break
        open_units = (flown.where(F.col("extra").isNull()).drop("extra").withColumn("buckets", F.ceil(F.col("buckets") / FAN))
                      .withColumn("bucket", F.floor(F.col("bucket") / FAN)))
        most = -(-most // FAN)
    cols = ["doc_id", "source", "hash", "size", "m", "source_size", "target", (F.col("base") + F.col("extra")).alias("copies")]
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in done])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1 or 2 times); columns as they were."""
    units = mix_units(docs, id_col, text_col, source_col).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("hash").alias("_hash"), F.col("copies").alias("_copies"))
    units = materialize(units, "mix_copies")
    # The row as one struct: columns named like those joined stay apart.
    rows = docs.select(F.struct("*").alias("_doc"), F.xxhash64(text_of(text_col)).alias("_text"), F.col(id_col).cast("long").alias("_doc_id"),
                       F.col(source_col).cast("string").alias("_from"))
    match = (F.col("_text") == F.col("_hash")) & F.col("_doc_id").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source"))
    return rows.join(units, match).select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to target weights by cube-method balanced sampling."""
    units = mix_units(read_table(spark, sf_dir, "documents"))
    return units.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
