"""N-gram Jaccard join by an LSH forest of MinHash prefixes, verified exactly.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, lower case; a document is its set of
five-word shingles (all its words as one shingle where it has fewer than five). Documents with one
set are one class. Two classes are linked when the Jaccard index of their sets is ``least`` or more.

Each class has ``TREES`` keys of ``DEEP`` MinHash values. Sorted, the keys of a tree form a prefix trie;
two classes are candidates when they share a prefix of some depth in some tree. The depth is the
longest one that finds a pair of likeness ``least`` with probability ``recall``; likelier pairs are found with
more, so neither a corpus nor its mix of likenesses changes which pairs are candidates. Prefixes that only
one class has never leave their task: a Bloom filter of the prefixes met twice finds them.

Candidates are gathered into components, and all pairs inside a component are verified on the whole
shingle sets. A component of many documents or shingles is cut into chunks, and every pair of
chunks is one bounded piece of work; pairs are counted there and never become rows. Only a spanning forest of
the links leaves a piece. Their components are the near-duplicate groups.

A null, empty or blank text has no shingles, is its own group and has no links. Repeated rows and
ids are rows like others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import (arrow, build_filter, code_points, column, filter_bits, filter_column, read_table, shuffle_partitions, spread,
                                  steps, strings, text_of)
from weekcraft.llm.components import components
from weekcraft.session import materialize

SHINGLE, LEAST = 5, 0.8
TREES, DEEP, RECALL = 20, 8, 0.999
#: Documents and shingles of a chunk of a component.
CHUNK_DOCS, CHUNK_SHINGLES = 512, 1_500_000

_rng = np.random.default_rng(20)
_ODD = (_rng.integers(0, 1 << 32, TREES * DEEP, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, TREES * DEEP, dtype=np.uint64).astype(np.uint32)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    points = code_points(text.lower())
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    letter = ~blank
    starts = np.flatnonzero(letter & np.r_[True, blank[:-1]]) if len(points) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    word = np.cumsum(letter & np.r_[True, blank[:-1]]) - 1
    place = np.arange(len(points)) - starts[word.clip(0)]
    mixed = spread(points.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(24)))
    mixed[blank] = 0
    words = np.add.reduceat(mixed, starts)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return np.unique(spread(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of every permutation over the shingles (uint32)."""
    low = (hashes >> np.uint64(16)).astype(np.uint32)
    out = np.full(len(_ODD), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (low[i:i + 1024] * _ODD[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, hash, digest, n, signature) per row; digest, n and signature null without words. ``hash`` is the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sets = [shingles(t) for t in strings(part)]
                yield pa.RecordBatch.from_arrays([
                    column(part, "uid"), column(part, "doc_id"), column(part, "hash"),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) or None for s in sets], pa.int32()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["uid", "doc_id", "hash", "digest", "n", "signature"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("hash"),
                       F.col(text_col).cast("string").alias("text")).transform(
        arrow,
        run, "uid long, doc_id long, hash long, digest binary, n int, signature binary")


def trie_entries(classes: DataFrame) -> DataFrame:
    """(tree, key, uid): a key is DEEP values of 16 bits, so a prefix of depth d is its first 2d bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(b"".join(column(batch, "signature").to_pylist()), dtype=np.uint32).reshape(n * TREES, DEEP)
            keys = (spread(values.astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                pa.Array.from_buffers(pa.binary(2 * DEEP), n * TREES, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary()),
                pa.array(np.repeat(column(batch, "uid").to_numpy(), TREES))], names=["tree", "key", "uid"])

    return classes.select("uid", "signature").transform(arrow, run, "tree int, key binary, uid long")


def _prefix(depth: int):
    return F.substring("key", 1, 2 * depth)


def shared_entries(classes: DataFrame, depth: int) -> DataFrame:
    """Entries whose prefix of this depth another class may have as well."""
    spark = classes.sparkSession
    node = F.xxhash64("tree", _prefix(depth))
    entries = trie_entries(classes)
    maybe = filter_column(spark, build_filter(entries.select(node.alias("key")), filter_bits(classes.count() * TREES), least=2))
    return materialize(entries.where(maybe(node)), "trie_entries")


def depth_for(least: float, recall: float) -> int:
    """The longest prefix that finds pairs of likeness ``least`` with the target recall, 1 where none does.

    A pair of likeness j is found at depth d with probability 1 - (1 - j**d)**TREES.
    """
    return next((d for d in range(DEEP, 1, -1) if 1 - (1 - least ** d) ** TREES >= recall), 1)


def candidate_edges(entries: DataFrame, depth: int) -> DataFrame:
    """Each class of a trie node linked to the node's least class (aggregated before the shuffle, joined back)."""
    nodes = materialize(entries.groupBy("tree", _prefix(depth).alias("prefix")).agg(F.min("uid").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1"), "trie_nodes")
    return (entries.withColumn("prefix", _prefix(depth)).join(nodes, ["tree", "prefix"]).select(F.col("uid").alias("u"), "v").where("u <> v").distinct())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over slices of the common shingles."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float64)
    if n <= 8:
        for i in range(n):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    _, col = np.unique(col[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = 2048
    cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + 1 + width, width))
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            x = np.zeros((n, width), dtype=np.float32)
            x[owner[a:b], col[a:b] % width] = 1
            out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def verified(uids: list[int], chunk: list[int], sets: list[np.ndarray], least: float, apart: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each class in this piece, spanning forest of the links).

    A piece of one chunk counts all its pairs, a piece of two (``apart``) only the pairs between them.
    """
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = overlaps(sets)
    linked = both >= least * (size[:, None] + size[None, :] - both) - 1e-9
    side = np.array(chunk)
    if apart:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    root = list(range(len(uids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = top(int(i)), top(int(j))
        if a != b:
            root[a] = b
            forest.append((uids[i], uids[j]))
    return linked.sum(axis=1), forest


def verify(docs: DataFrame, classes: DataFrame, members: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """(u, v, links): rows with v are verified links of a spanning forest, rows without carry link counts of u."""
    spark = docs.sparkSession
    members = members.join(classes.select(F.col("uid").alias("node"), "digest", "n", F.coalesce(F.col("doc_id"), F.lit(0)).alias("id")), "node")
    members = materialize(members, "candidates")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    placed = materialize(members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "placed")
    wanted = filter_column(spark, build_filter(placed.select(F.col("id").alias("key")), filter_bits(placed.count())))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                made = [s for s in map(shingles, strings(part)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())],
                                                 names=["digest", "shingles"])

    texts = docs.where(wanted(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))).select(F.col(text_col).cast("string").alias("text"))
    rows = texts.transform(arrow, sets, "digest binary, shingles binary").join(placed.select("root", "node", "chunks", "chunk", "digest"), "digest")
    pieces = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "chunk", "shingles")
              .repartition(shuffle_partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, uids, chunk, held = None, [], [], []
        out: list[tuple] = []

        def close() -> None:
            if len(uids) > 1:
                links, forest = verified(uids, chunk, held, least, key[1] != key[2])
                out.extend((u, None, int(n)) for u, n in zip(uids, links, strict=True) if n)
                out.extend((a, b, 0) for a, b in forest)

        def rows_of() -> pa.RecordBatch:
            u, v, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "links"])

        for batch in batches:
            names = [column(batch, c).to_pylist() for c in ("root", "i", "j", "node", "chunk")]
            for k, (root, i, j, node, side) in enumerate(zip(*names, strict=True)):
                if (root, i, j) != key:
                    close()
                    key, uids, chunk, held = (root, i, j), [], [], []
                    if len(out) > 50_000:
                        yield rows_of()
                        out.clear()
                if uids and uids[-1] == node:  # another row with the same set
                    continue
                uids.append(node)
                chunk.append(side)
                held.append(np.frombuffer(column(batch, "shingles")[k].as_py(), dtype=np.uint64))
        close()
        if out:
            yield rows_of()

    return pieces.transform(arrow, run, "u long, v long, links long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """One row per row: doc_id, class_id (least id of the near-duplicate group), n_links (other texts
    linked to this one), n_same (rows with the same shingle set), stays (the group's row to keep:
    least id, then first read), hash (of the text).
    """
    rows = materialize(document_sets(docs, id_col, text_col), "document_sets")
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("uid"))
    classes = materialize(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n_same"), F.first("n").alias("n"), F.first("signature").alias("signature"))
        .select("digest", F.col("first.uid").alias("uid"), F.col("first.doc_id").alias("doc_id"), "first", "n_same", "n", "signature"), "classes")
    depth = depth_for(least, recall)
    members = components(candidate_edges(shared_entries(classes, depth), depth))
    checked = materialize(verify(docs, classes, members, least, id_col, text_col), "checked")
    linked = components(checked.where("v is not null").select("u", "v"))
    counts = checked.where("v is null").groupBy("u").agg(F.sum("links").alias("n_links"))
    grouped = (classes.select("digest", "uid", "first", "n_same").join(linked, F.col("uid") == F.col("node"), "left").drop("node")
               .join(counts, F.col("uid") == F.col("u"), "left").drop("u")
               .withColumn("root", F.coalesce("root", "uid")))
    heads = materialize(grouped.groupBy("root").agg(F.min("first").alias("head")), "heads")
    classed = materialize(materialize(grouped, "grouped").join(heads, "root").select("digest", "n_same", "n_links", "head"), "classed")
    with_words = rows.where(F.col("digest").isNotNull()).select("uid", "doc_id", "hash", "digest").join(classed, "digest").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_same",
        (F.col("head.uid") == F.col("uid")).alias("stays"), "hash")
    without = rows.where(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                                          F.lit(1).cast("long").alias("n_same"), F.lit(True).alias("stays"), "hash")
    return with_words.unionByName(without)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, columns as they were.

    Rows that repeat both id and text stay or go together. Only rows that a Bloom filter of the
    dropped ones may hold are joined with them; all others pass straight through.
    """
    spark = docs.sparkSession
    found = materialize(near_groups(docs, id_col, text_col, least, recall).select("doc_id", "hash", "stays"), "near_groups")
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("hash"))
    gone = materialize(found.groupBy("doc_id", "hash").agg(F.max("stays").alias("stays")).where(~F.col("stays")).select(key.alias("key")), "dropped")
    maybe = filter_column(spark, build_filter(gone, filter_bits(gone.count())))
    own = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(text_of(text_col)))
    # The row as one struct: columns named like those added here stay apart.
    marked = docs.select(F.struct("*").alias("_doc"), own.alias("_key")).withColumn("_maybe", maybe(F.col("_key")))
    kept = marked.where("_maybe").join(gone.select(F.col("key").alias("_key")), "_key", "leftanti")
    return marked.where(~F.col("_maybe")).select("_doc.*").unionByName(kept.select("_doc.*"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join of all documents by a MinHash LSH forest, with exact verification."""
    return near_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_same")
