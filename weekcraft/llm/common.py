"""Helpers shared by the text operators: columns, folds, batches and broadcast filters."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Characters that one step of a per-document kernel takes at once (bounds a task's memory).
STEP_CHARS = 2_000_000


#: Bytes of text that a training sample holds at most.
SAMPLE_BYTES = 64 << 20


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer's file: in ``folder``, else where the package of vocabularies has it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; -1 for a null id (in no fold)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(-1))


def hash_limit(most: float, total: float) -> int:
    """The 64-bit hash below which about ``most`` of ``total`` rows lie, with a margin that makes fewer unlikely.

    The share is taken of the whole 64-bit range, so it does not vanish for any number of rows.
    """
    share = (most + 6 * most ** 0.5 + 16) / max(1.0, total)
    return 2 ** 63 - 1 if share >= 1 else int(share * 2.0 ** 64) - 2 ** 63


def hash_sample(rows: DataFrame, counts: dict, most: float, key: str = "doc_id", text: str = "text", group: str | None = None,
                most_bytes: int = SAMPLE_BYTES, seed: int = 3) -> DataFrame:
    """(group, hash, text): of every group the ``most`` rows with the smallest hashes of ``key``, as far as their texts
    fit into the group's equal share of ``most_bytes``; a text of over a quarter of that share is passed over.

    counts: rows per group (``{None: rows}`` without a group). Of rows with one key and group the least text
    counts. Only hashes and lengths of about ``most`` rows per group come to the driver before the texts are read.
    """
    if not counts:
        return rows.select(F.lit(None).cast("string").alias("group"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("text")).limit(0)
    of = F.lit("").alias("group") if group is None else F.col(group).cast("string").alias("group")
    names = {g: "" if group is None else str(g) for g in counts}

    def per_group(values: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for g, v in values.items() for x in (names[g], int(v))]), F.col("group"))

    least = F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")
    near = (rows.withColumns({"group": of, "hash": F.xxhash64(F.col(key), F.lit(seed))})
            .where(F.col("hash") <= per_group({g: hash_limit(most, n) for g, n in counts.items()})).groupBy("group", "hash").agg(least))
    share = most_bytes // len(counts)
    fits = F.octet_length("text") <= share // 4
    sizes = near.where(fits).select("group", "hash", F.octet_length("text").alias("n")).collect()
    last = {}
    for g, name in names.items():
        held = 0
        for taken, r in enumerate(sorted((r for r in sizes if r["group"] == name), key=lambda r: r["hash"])):
            held += r["n"]
            if held > share or taken >= most:
                break
            last[g] = r["hash"]
    if not last:
        return near.limit(0)
    return near.where(fits & (F.col("hash") <= per_group(last)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with bounded memory.

    A task gives its freed memory back at its end, because Spark keeps Python workers for later tasks.
    """
    small_batches(rows.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return rows.mapInArrow(bounded, schema)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches from its default of 64 MB to ``BATCH_BYTES``.

    Long texts would fill the default in every task, in the JVM and in Python. A value that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory of this worker back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes (one longer text is a slice of its own)."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python texts, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def cut_points(rows: DataFrame, name: str, parts: int) -> np.ndarray:
    """At most ``parts - 1`` ascending values that cut a number column into about equal ranges; none for no rows."""
    if parts < 2:
        return np.zeros(0)
    found = rows.agg(F.percentile_approx(name, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return np.array(sorted(set(found or ())), dtype=np.float64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def letter_table(digits: bool = True) -> np.ndarray:
    """Code point -> lower-case code point for letters (and all digits and numbers), 0 for everything else (built once a worker)."""
    if digits not in _LETTERS:
        out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(0x40000):
            s = chr(c)
            if s.isalnum() if digits else s.isalpha():
                out[c] = ord(low) if len(low := s.lower()) == 1 else c
        _LETTERS[digits] = out
    return _LETTERS[digits]


_LETTERS: dict[bool, np.ndarray] = {}


def spread(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit (uint64 -> uint64)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


# --- Bloom filters -------------------------------------------------------------------------

#: Bits of one block of a filter; the blocks of a filter are merged apart from each other.
BLOCK_BITS = 1 << 16


def filter_bits(rows: int, per_row: int = 16, most: int = 1 << 30) -> int:
    """Bits of a filter for ``rows`` keys: a power of two, at most ``most`` (128 MB).

    Beyond ``most`` the filter fills up: it lets more rows through to the exact step that
    follows, and results stay the same.
    """
    bits = BLOCK_BITS
    while bits < min(rows * per_row, most):
        bits *= 2
    return bits


def positions(keys: np.ndarray, bits: int, hashes: int = 2) -> np.ndarray:
    """Bit positions (hashes, rows) of 64-bit keys by double hashing."""
    a, b = spread(keys), spread(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(hashes)])


def build_filter(keys: DataFrame, bits: int, least: int = 1, hashes: int = 2) -> np.ndarray:
    """Packed bits of the filter over the bigint column ``key``: positions that ``least`` (1 or 2) rows set.

    Every task sends the positions it met, as 16-bit offsets by block, with those it met twice
    kept apart; blocks are merged on the executors, and the driver gets the merged bits
    (``bits`` / 8 bytes at most).
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            k = column(batch, "key").drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            held.append(positions(k, bits, hashes).ravel())
            n += len(k)
            if n >= 2_000_000:
                yield from blocks(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from blocks(np.concatenate(held))

    def blocks(at: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, times = np.unique(at, return_counts=True)
        if not len(at):
            return
        block = (at >> np.uint64(16)).astype(np.int64)
        low, twice = (at & np.uint64(0xFFFF)).astype("<u2"), times > 1
        cuts = np.flatnonzero(np.diff(block)) + 1
        spans = list(zip([0, *cuts], [*cuts, len(at)], strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array([int(block[i]) for i, _ in spans], pa.int64()),
            pa.array([low[i:j][~twice[i:j]].tobytes() for i, j in spans], pa.binary()),
            pa.array([low[i:j][twice[i:j]].tobytes() for i, j in spans], pa.binary())], names=["block", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seen = np.zeros(BLOCK_BITS, dtype=np.int64)
        for name, weight in (("once", 1), ("twice", 2)):
            low = np.frombuffer(b"".join(table.column(name).to_pylist()), dtype="<u2")
            seen += weight * np.bincount(low, minlength=BLOCK_BITS)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(seen >= least).tobytes()], pa.binary())})

    merged = (arrow(keys, local, "block long, once binary, twice binary")
              .groupBy("block").applyInArrow(merge, "block long, bits binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.collect():
        out[row["block"] * BLOCK_BITS // 8:(row["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def in_filter(packed: np.ndarray, keys: np.ndarray, hashes: int = 2) -> np.ndarray:
    at = positions(keys, len(packed) * 8, hashes)
    return (((packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1) > 0).all(axis=0)


def filter_column(spark: SparkSession, packed: np.ndarray, hashes: int = 2):
    """A function Column(bigint) -> Column(boolean): whether the key may be in the filter."""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, key.to_numpy().astype(np.int64).view(np.uint64), hashes))

    return maybe
