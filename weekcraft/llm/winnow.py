"""Document fingerprints by winnowing.

A text is reduced to its letters and digits (lower case, by code point). A rolling hash of
every ``k`` of them in a row is taken, and of every ``window`` consecutive hashes the smallest
is marked, the rightmost one on ties. The marked hashes are the fingerprint; each keeps the
code point offset in the original text of the first character of its k-gram. Any passage of
``k + window - 1`` letters and digits that two texts share marks at least one common hash
(the match guarantee), and no passage shorter than ``k`` can.

A text with 1 to k-1 letters and digits gets one mark, the hash of all of them at the offset of
the first; with none (null, empty, blank, punctuation) the fingerprint is empty. Equal texts
have equal fingerprints. The likeness of two fingerprints is the Jaccard index of their distinct
hashes; of two empty ones it is 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, code_points, column, cut_points, letter_table, read_table, shuffle_partitions, spread, steps, strings

K, WINDOW = 16, 17


def rolling_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive symbols, as uint32.

    Built by doubling: the polynomial hash of 2m symbols is that of the first m times base**m
    plus that of the last m, so k takes log2(k) vector steps.
    """
    run, power, length = symbols.astype(np.uint64) + np.uint64(0x51ED27), np.array([0x100000001B3], np.uint64), 1
    out, have = None, 0
    while True:
        if k & length:
            if out is None:
                out, have = run, length
            else:
                n = len(symbols) - have - length + 1
                out, have = out[:n] * power + run[have:have + n], have + length
        if have == k:
            return (spread(out[:len(symbols) - k + 1]) >> np.uint64(32)).astype(np.uint32)
        n = len(symbols) - 2 * length + 1
        run, power, length = run[:n] * power + run[length:length + n], power * power, 2 * length


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Ascending indexes of the minimum of every ``window`` consecutive hashes, rightmost on ties."""
    n = len(hashes)
    window = min(window, n)
    # One word holds the hash and the distance from the end, so the least word is the rightmost minimum.
    words = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    length = 1
    while 2 * length <= window:
        words, length = np.minimum(words[:-length], words[length:]), 2 * length
    if length < window:
        words = np.minimum(words[:len(words) - (window - length)], words[window - length:])
    at = (n - 1) - (words & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the marks of a text, in text order."""
    symbols = letter_table()[code_points(text)]
    offsets = np.flatnonzero(symbols)
    symbols = symbols[offsets]
    if not len(symbols):
        return np.zeros(0, np.uint32), offsets
    k = min(k, len(symbols))
    hashes = rolling_hashes(symbols, k)
    at = window_minima(hashes, window)
    return hashes[at], offsets[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets given as sorted distinct arrays; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row: doc_id, n_chars, hashes array<long>, offsets array<int> (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                texts = strings(part)
                marks = [winnow(t, k, window) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([h.astype(np.int64) for h, _ in marks], pa.list_(pa.int64())),
                    pa.array([o.astype(np.int32) for _, o in marks], pa.list_(pa.int32()))], names=["doc_id", "n_chars", "hashes", "offsets"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        arrow,
        run, "doc_id long, n_chars long, hashes array<long>, offsets array<int>")


def _laid_out(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (key, doc_id, text, bucket, guest) in descending order within ``parts`` ranges of ids.

    Ids alone give the cut points. The texts are shuffled once, by range, and the largest row of
    every range visits the next higher range as a guest, where the smallest row finds its
    successor; the largest row of all, which follows the last, visits the lowest range. There is
    one such row per range. Null ids sort last.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("key"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    cuts = cut_points(rows, "key", parts)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype(np.float64), side="right").astype(np.int32))

    tops = {r["b"]: r["top"] for r in rows.groupBy(bucket_of("key").alias("b")).agg(F.max("key").alias("top")).collect()}
    filled = sorted(tops)
    visits = {tops[b]: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}

    @F.pandas_udf("int")
    def visit_of(key: pd.Series) -> pd.Series:
        return key.map(visits).astype("Int32")

    own = F.struct(bucket_of("key").alias("bucket"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("_visit").alias("bucket"), F.lit(True).alias("guest"))
    return (rows.withColumn("_visit", visit_of("key"))
            .withColumn("_own", own)
            .withColumn("_at", F.explode(F.when(F.col("_visit").isNull(), F.array("_own")).otherwise(F.array("_own", visit))))
            .select("key", "doc_id", "text", "_at.bucket", "_at.guest")
            .repartitionById(parts, F.col("bucket"))
            .sortWithinPartitions("bucket", "guest", F.col("key").desc(), "text"))


def edited_text(text: str, successor: str) -> str:
    """The last half of the code points replaced by as many (or all) first ones of the successor."""
    half = len(text) // 2
    return text[:len(text) - half] + successor[:half]


def compare_with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW,
                           parts: int | None = None) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and its likeness to both neighbours.

    Rows with one doc_id follow each other by text. Each task streams its sorted rows and holds
    two texts at a time, so ranges of any size fit. An empty table gives an empty result.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, marks int")

    def packed(hashes: np.ndarray) -> str:
        return hashes.astype(">u4").tobytes().hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None
        size = 0
        for batch in batches:
            for part in steps(batch):
                for doc, text, bucket, guest in zip(column(part, "doc_id").to_pylist(), strings(part), column(part, "bucket").to_pylist(),
                                                    column(part, "guest").to_pylist(), strict=True):
                    hashes, _ = winnow(text, k, window)
                    distinct = np.unique(hashes)
                    if held is not None and held[2] == bucket and not held[3]:
                        edited = edited_text(held[1], text)
                        marks, _ = winnow(edited, k, window)
                        out.append((held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8")).hexdigest(), packed(held[4]), packed(marks),
                                    likeness(held[5], np.unique(marks)), likeness(held[5], distinct), len(held[4])))
                        size += len(edited)
                    held = (doc, text, bucket, guest, hashes, distinct)
                    if size > 4_000_000:
                        yield rows(out)
                        out, size = [], 0
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                          names=[f.split()[0] for f in schema.split(", ")])

    return _laid_out(docs, id_col, text_col, parts).transform(arrow, run, schema)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document fingerprints: winnowing marks of every text and of its edited text, and their likeness."""
    return compare_with_successor(read_table(spark, sf_dir, "documents"))
