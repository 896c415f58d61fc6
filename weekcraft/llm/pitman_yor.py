"""Language-model scores by a hierarchical Pitman-Yor process.

Every word has a restaurant for the tokens that follow it, in which each word is a dish and each training token a customer; the
text's start has one too. All restaurants share one parent, the root, whose customers are their tables; its base is uniform over
the known words and one unknown word. A word never seen before a token leaves the token to the root.

Seating is sampled by Gibbs. A party is the customers of one dish in one restaurant, and what predictions need of
its seating is its number of tables. A sweep lifts every party and seats it again, given the seating of all
others: the number of tables t of c customers is drawn from its exact conditional,

    p(t) ~ S(c, t) * base**t * prod_{s<t} (strength + discount * (tables of the others + s)),

with S the generalised Stirling numbers, which sum over all seatings of the party with t tables. Of a party of more than
``PARTY`` customers the first ``PARTY`` are drawn so; the others come in blocks of an eighth of those seated, and a block
opens its expected number of tables, rounded at random. Parties are lifted side by side: each sees the
tables that other words and restaurants had after the sweep before. After ``burn`` sweeps the predictive probabilities of
``samples`` sweeps are averaged. Discounts are n1 / (n1 + 2 n2) of the parties' and of the words' sizes.

Counts cover all training texts. A task adds up its (word, context) pairs before the shuffle, and all sums are grouped, so a common
word or pair is no hot key. The words with at least T occurrences, T the least eighth of a power of two that leaves ``most_common``,
are coded by small numbers, and their sums are looked up in place in every sweep; only parties with another word are shuffled to meet
that word's row. What the driver holds does not grow: the coded words' sums and, for scoring, the weights of the ``most_pairs`` most frequent
pairs of two of them. Other pairs are shuffled to meet theirs. Pairs of coded words are dealt to buckets, of which there are as many as the
training tokens need; a pair with another word goes to that word's bucket. Pairs, and the sums of texts, are shuffled and staged in
packed blocks of a bucket; parties and tokens of two words without a code, and tokens that meet such a word's row, are a row each. Words are known by 55 bits of a hash: of a billion words about
fourteen pairs would be taken for one word.

Random numbers are hashes of (word, context, sweep), so any partitioning gives the same seating. Null texts are
empty: one end token. Rows without an id are scored but not learned from, repeated rows count each time. Without training texts
every word has probability 1. An empty table gives an empty result; other columns are ignored. Long texts are read in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weekcraft.llm.common import BATCH_BYTES, arrow, column, fold_of, read_table, release, spread, steps, strings
from weekcraft.session import drop_stage, materialize

#: Customers of an exactly seated party; words coded, and pairs of them held, to be looked up in place.
PARTY, MOST_COMMON, MOST_PAIRS = 512, 1 << 17, 1 << 20
#: The end of a text as a word, and before its first token; no hash is 0. Bits of a coded word; words without a code are at least FIRST.
END = 0
SHIFT = 20
FIRST = 1 << SHIFT
SEGMENT = 1 << 20
#: Rounds (shares of the buckets) in which scoring shuffles its pairs of two coded words, and those with another word, to meet the model's.
NEAR_ROUNDS, FAR_ROUNDS = 1, 1
PAIRS = 4_000_000
#: Training tokens whose pairs share a bucket; texts whose sums share one are 2 ** ROWS.
BLOCK, ROWS = 1 << 20, 13
#: Pairs of a block that is kept.
KEPT = 1 << 15
#: Spark's settings to remove a query's shuffle files when it ends, for smaller Parquet files than by default, and for few blocks read at once.
SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd",
          "spark.sql.parquet.columnarReaderBatchSize": "128"}

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += 32
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.r_[np.uint64(1), np.full((1 << 16) - 1, 0x100000001B3, dtype=np.uint64)])
    _FAR = _POWERS[-1] * np.uint64(0x100000001B3)


# --- tokens --------------------------------------------------------------------------------

def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 55 bits, start offsets) of the words of a byte text, A-Z as a-z."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = _BLANK[raw]
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64), starts
    first = starts[0]
    symbol = _LOWER[raw[first:]] + np.uint64(1)
    symbol[blank[first:]] = 0
    at = np.arange(len(symbol)) - np.repeat(starts - first, np.diff(np.r_[starts, len(raw)]))
    symbol *= _POWERS[at & 0xFFFF]
    if (ends - starts).max() > len(_POWERS):
        far = at >> 16
        for k in range(1, int((ends - starts).max() - 1 >> 16) + 1):
            symbol[far >= k] *= _FAR
    h = np.add.reduceat(symbol, starts - first) + (ends - starts).astype(np.uint64)
    return np.maximum(spread(h) >> np.uint64(9), np.uint64(1)).astype(np.int64), starts


def pieces_of(texts: list[str]) -> Iterator[list[tuple[int, bytes, bool, bool]]]:
    """Lists of (text number, bytes, first piece, last piece) of about ``SEGMENT`` bytes; texts are cut at blanks."""
    held: list[tuple[int, bytes, bool, bool]] = []
    size = 0
    for k, text in enumerate(texts):
        data = text.encode("utf-8")
        if len(data) <= SEGMENT:
            held.append((k, data, True, True))
            size += len(data)
        else:
            if held:
                yield held
            held, size, at = [], 0, 0
            while at < len(data):
                end = min(len(data), at + SEGMENT)
                while end < len(data) and not _BLANK[data[end]]:
                    end += 1
                yield [(k, data[at:end], at == 0, end == len(data))]
                at = end
        if size >= SEGMENT:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, the word before it, text number) of all tokens, ends included, piece list by piece list.

    From the second token of a list on, the word before is that of the token before; ``END`` stands before a text.
    """
    before = END
    for held in pieces_of(texts):
        words, starts = word_hashes(b"\n".join(d for _, d, _, _ in held) + b"\n")
        borders = np.cumsum([len(d) + 1 for _, d, _, _ in held])
        upto = np.searchsorted(starts, borders)
        closing = np.array([last for *_, last in held])
        own = np.diff(np.r_[0, upto]) + closing
        words = np.insert(words, upto[closing], END)
        previous = np.empty_like(words)
        previous[1:] = words[:-1]
        previous[:1] = END if held[0][2] else before
        if len(words):
            before = int(words[-1])
        yield words, previous, np.repeat([k for k, *_ in held], own)


class Index:
    """Places of distinct numbers by a table of slots; numbers that share a slot are found by bisection."""

    def __init__(self, keys: np.ndarray):
        """keys: ascending"""
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        slots = self.slot(keys)
        self.table = np.full(1 << 64 - int(self.shift), -1, dtype=np.int32)
        self.table[slots] = np.arange(len(keys))
        shared = np.bincount(slots, minlength=len(self.table)) > 1
        self.table[shared] = -2

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every number, -1 of those that are not held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.table[self.slot(keys)].astype(np.int64)
        if len(shared := np.flatnonzero(at == -2)):
            at[shared] = np.minimum(np.searchsorted(self.keys, keys[shared]), len(self.keys) - 1)
        at[self.keys[at] != keys] = -1
        return at


@dataclass
class Codes:
    """The words from some number of occurrences on, coded by frequency: 0, 1, ...; all others keep their hash."""
    hashes: np.ndarray
    ranks: np.ndarray
    #: Built where words are first looked up.
    index: Index | None = field(default=None, repr=False, compare=False)
    #: Tokens of the texts that were counted.
    tokens: int = 0

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self):
            return words + FIRST
        if self.index is None:
            self.index = Index(self.hashes)
        at = self.index.find(words)
        return np.where(at >= 0, self.ranks[at], words + FIRST)

    def runs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``token_runs`` in codes."""
        for words, previous, text in token_runs(texts):
            word = self.of(words)
            yield word, np.r_[self.of(previous[:1]), word[:-1]], text


def least_count(rows: DataFrame, most: int, times: Column | int = 1) -> int | None:
    """T, the least eighth of a power of two so that at most ``most`` rows have an ``n`` from T on (as the least such n); None if there is none.

    times: rows that a row stands for.
    """
    power = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    left, least = most, None
    times = F.lit(times) if isinstance(times, int) else times
    for r in rows.groupBy(power.alias("p")).agg(F.sum(times).alias("k"), F.min("n").alias("n")).orderBy(F.col("p").desc()).collect():
        if (left := left - r["k"]) < 0:
            break
        least = r["n"]
    return least


def from_least(least: int | None) -> Column:
    return F.lit(False) if least is None else F.col("n") >= least


def texts_of(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def common_words(docs: DataFrame, text_col: str = "text", most: int = MOST_COMMON) -> Codes:
    """The codes of the ``most`` most frequent words, or somewhat fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                for part in steps(batch):
                    for words, _, _ in token_runs(strings(part)):
                        yield words

        for held in chunks(found()):
            words, n = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["word", "n"])

    counted = staged(texts_of(docs, text_col).transform(arrow, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    got = fetched(counted.where(from_least(least_count(counted, min(most, FIRST)))))
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    drop_stage(counted)
    by_hash = np.argsort(got["word"])
    ranks = np.empty_like(by_hash)
    ranks[np.lexsort((got["word"], -got["n"]))] = np.arange(len(ranks))
    return Codes(got["word"][by_hash], ranks[by_hash], tokens=tokens)


def chunks(found: Iterator[np.ndarray], most: int | None = None) -> Iterator[np.ndarray]:
    """Arrays (joined along their last axis) of about ``most`` (``PAIRS``) tokens."""
    held: list[np.ndarray] = []
    n = 0
    for x in found:
        held.append(x)
        n += x.shape[-1]
        if n >= (most or PAIRS):
            yield np.concatenate(held, axis=-1)
            held, n = [], 0
    if held:
        yield np.concatenate(held, axis=-1)


# Pairs cross a shuffle as blocks: a row holds many pairs of one bucket, packed, so that a pair is no row of its own.

def buckets_for(tokens: int) -> int:
    return max(1, -(-tokens // BLOCK))


def bucket_of(word: np.ndarray, context: np.ndarray, common: int, buckets: int) -> np.ndarray:
    """The bucket of every pair: of two coded words by both, else by the word that ``rare_of`` names."""
    h = np.where(word >= common, word, context).view(np.uint64)
    coded = (word < common) & (context < common)
    h = spread(np.where(coded, (word << SHIFT | context & FIRST - 1).view(np.uint64), h))
    return ((h >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def bucket_order(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Order by bucket, otherwise as before (few buckets are sorted by digits)."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers of one length, byte plane by byte plane, which compresses well."""
    raw = np.stack([a.view(np.int64) for a in arrays])
    return raw.view(np.uint8).reshape(len(arrays), -1, 8).transpose(0, 2, 1).tobytes()


def unpack(data, arrays: int) -> np.ndarray:
    """(arrays, numbers) of ``pack``, as whole numbers."""
    planes = np.frombuffer(data, dtype=np.uint8).reshape(arrays, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[..., 0]


def unpacked(blocks: pa.Array, arrays: int) -> np.ndarray:
    """The numbers of several blocks, joined."""
    found = [unpack(b.as_buffer(), arrays) for b in blocks if b.is_valid]
    return np.concatenate(found, axis=1) if found else np.zeros((arrays, 0), np.int64)


def by_bucket(bucket: np.ndarray, arrays: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed arrays) of rows ordered by bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if i < j:
            yield int(bucket[i]), pack(*(a[i:j] for a in arrays))


def block_rows(blocks: Iterator[tuple[int, bytes]], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches (bucket, block) of about ``most`` bytes."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for block in blocks:
        held.append(block)
        size += len(block[1])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], names=["bucket", "block"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], names=["bucket", "block"])


def counted_pairs(word: np.ndarray, context: np.ndarray, n: np.ndarray | None, common: int) -> tuple[np.ndarray, ...]:
    """Distinct (word, context) and the sums of n (of ones)."""
    out = []
    coded = (word < common) & (context < common)
    for mine in (coded, ~coded):
        w, u = word[mine], context[mine]
        if mine is coded and n is None:
            key = w << SHIFT | u
            key.sort()
            w, u = key >> SHIFT, key & FIRST - 1
        else:
            order = np.argsort(w << SHIFT | u) if mine is coded else np.lexsort((u, w))
            w, u = w[order], u[order]
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (u[1:] != u[:-1])][:len(w)])
        sums = np.diff(np.r_[first, len(w)]) if n is None else np.add.reduceat(n[mine][order], first) if len(w) else np.zeros(0, np.int64)
        out.append((w[first], u[first], sums))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pair_counts(docs: DataFrame, codes: Codes, text_col: str = "text") -> DataFrame:
    """Blocks (coded, ones, twos, block) of (word, context, n) of all texts, grouped; coded ones hold pairs of coded words, others the others. A task sums ``PAIRS`` tokens at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    common, buckets = len(codes), buckets_for(codes.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                for part in steps(batch):
                    for word, context, _ in shared.value.runs(strings(part)):
                        yield np.stack([word, context])

        for word, context in chunks(found()):
            word, context, n = counted_pairs(word, context, None, common)
            bucket = bucket_of(word, context, common, buckets)
            order = bucket_order(bucket, buckets)
            yield from block_rows(by_bucket(bucket[order], (word[order], context[order], n[order])))

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        word, context, n = counted_pairs(*unpacked(table.column("block"), 3), common)
        far = int(((word < common) & (context < common)).sum())  # pairs of coded words come first
        parts = [slice(i, min(i + KEPT, end)) for start, end in ((0, far), (far, len(n))) for i in range(start, end, KEPT)]
        release()
        return pa.table({"coded": pa.array([i.stop <= far for i in parts], pa.bool_()), "ones": pa.array([int((n[i] == 1).sum()) for i in parts], pa.int64()), "twos": pa.array([int((n[i] == 2).sum()) for i in parts], pa.int64()),
                         "block": pa.array([pack(word[i], context[i], n[i]) for i in parts], pa.binary())})

    return (texts_of(docs, text_col).transform(arrow, run, "bucket long, block binary").groupBy("bucket").applyInArrow(merge, "coded boolean, ones long, twos long, block binary"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with small files; what the write shuffled is removed when it ends, so shuffles of earlier steps do not pile up on disk."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in SAVING}
    for key, value in SAVING.items():
        conf.set(key, value)
    try:
        return materialize(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


# --- seating -------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def stirling_logs(discount: float, most: int = PARTY) -> np.ndarray:
    """log S(c, t): summed weights of the ways to seat c customers at t tables, the tables' bases left out."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1:c + 2] = np.logaddexp(out[c, :c + 1], np.log(np.maximum(c - discount * t, 0.0)) + out[c, 1:c + 2])
    return out


def uniforms(*keys) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys alone."""
    h = np.uint64(0)
    for k in keys:
        h = spread(h + np.atleast_1d(np.asarray(k, dtype=np.int64)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def draw_tables(customers: np.ndarray, base: np.ndarray, others: np.ndarray, strength: float, discount: float, logs: np.ndarray, keys: tuple) -> np.ndarray:
    """Number of tables of every party; others: tables of the other parties in its restaurant, base: the parent's probability."""
    most = len(logs) - 1
    tables = np.minimum(customers, 1)
    u = uniforms(*keys, 0)
    exact = np.minimum(customers, most)
    top = 1
    while top < most:
        low, top = top, min(most, 2 * top)
        rows = np.flatnonzero((exact > low) & (exact <= top))
        for at in range(0, len(rows), block := max(1, (1 << 20) // top)):
            r = rows[at:at + block]
            w = np.cumsum(np.log(strength + discount * (others[r, None] + np.arange(top))), axis=1)
            w += np.log(base[r])[:, None] * np.arange(1, top + 1) + logs[exact[r], 1:top + 1]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            tables[r] = 1 + (w < u[r, None] * w[:, -1:]).sum(axis=1)
    large = np.flatnonzero(customers > most)
    seated, k = np.full(len(large), most), 0
    while len(large):
        k += 1
        block = np.minimum(np.maximum(1, seated // 8), customers[large] - seated)
        new = (strength + discount * (others[large] + tables[large])) * base[large]
        share = new / (new + seated - discount * tables[large])
        tables[large] += np.minimum(block, np.floor(block * share + uniforms(*(x[large] if np.ndim(x) else x for x in keys), k))).astype(np.int64)
        seated = seated + block
        left = seated < customers[large]
        large, seated = large[left], seated[left]
    return tables


@dataclass
class Restaurants:
    """What a seating says of all words together; root_customers[k] and root_tables[k] are the root's sums after sweep k."""
    discount: float
    root_discount: float
    tokens: int
    words: int
    strength: float = 1.0
    root_strength: float = 1.0
    root_customers: list[int] = field(default_factory=list)
    root_tables: list[int] = field(default_factory=list)
    #: For small models: (customers; tables per kept sweep) of all restaurants, by their words' codes.
    read: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None

    @property
    def customers(self) -> np.ndarray:
        return self.read()[0]

    @property
    def tables(self) -> np.ndarray:
        return self.read()[1]

    @property
    def uniform(self) -> float:
        return 1.0 / (self.words + 1)

    def escape(self, customers, tables):
        """The weight of the parent's probability in a restaurant of so many customers and tables."""
        return (self.strength + self.discount * tables) / (self.strength + customers)

    def root(self, customers, tables, k: int):
        """The root's probability of words with so many customers and tables after sweep k."""
        rest = (self.root_strength + self.root_discount * self.root_tables[k]) * self.uniform
        return (customers - self.root_discount * tables + rest) / (self.root_strength + self.root_customers[k])


PARTY_COLUMNS = ("word", "context", "n", "tables", "kept")
#: A row is a party of two words without a code, or a block of parties: of coded words, or with a bucket those of one coded word in it.
PARTIES = "bucket long, word long, context long, n long, tables long, kept long, block binary"
WORDS = "word long, n long, fixed long, fixed_tables long, customers long, tables long, seats long"


def rare_of(common: int) -> Column:
    """Of a pair with a word without a code: that word, of two such words the latter."""
    return F.when(F.col("word") >= common, F.col("word")).otherwise(F.col("context"))


def in_round(at: Column, k: int, rounds: int) -> Column:
    """Whether a key's turn is round k; equal keys have the same."""
    return F.pmod(F.xxhash64(at), F.lit(rounds)) == k


def with_words(rows: DataFrame, words: DataFrame, common: int, columns: tuple[str, ...]) -> DataFrame:
    """Rows of pairs of words without a code with ``columns`` of the word, as rare_*, and of the context, as context_*.

    Words without a code have few occurrences, so none is a hot key.
    """
    return with_word(with_word(rows, words, common, columns, rare_of(common), "rare"), words, common, columns, F.col("context"), "context")


def with_word(rows: DataFrame, words: DataFrame, common: int, columns: tuple[str, ...], at: Column, prefix: str) -> DataFrame:
    side = words.where(F.col("word") >= common).select(F.col("word").alias("_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return rows.withColumn("_at", at).join(side, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")


def coded(words: DataFrame, common: int, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns of the coded words by code, as broadcast to look them up in place."""
    got = fetched(words.where(F.col("word") < common).select("word", *columns))
    out = {c: np.zeros(max(1, common), dtype=np.int64) for c in columns}
    for c in columns:
        out[c][got["word"]] = got[c]
    return out


def fetched(rows: DataFrame) -> dict[str, np.ndarray]:
    """Columns of numbers, in the driver."""
    got = rows.toArrow()
    return {c: x.to_numpy() for c, x in zip(got.column_names, got.columns, strict=True)}


def looked_up(batch: pa.RecordBatch, side: str, name: str, coded: dict[str, np.ndarray], common: int) -> np.ndarray:
    """A column of the words on one side of the pairs of a batch: of coded words in place, of others as ``with_words`` joined it, 0 for unknown words."""
    at = column(batch, side).to_numpy()
    out = coded[name][np.where(at < common, at, 0)]

    def joined(prefix: str) -> np.ndarray:
        return pa.compute.fill_null(column(batch, f"{prefix}_{name}"), 0).to_numpy(zero_copy_only=False)

    if f"rare_{name}" in batch.schema.names:
        out = np.where(at < common, out, joined("context" if side == "context" and f"context_{name}" in batch.schema.names else "rare"))
    return out


def pair_arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The pairs of a batch of ``pair_counts``."""
    word, context, n = unpacked(column(batch, "block"), 3)
    return {"word": word, "context": context, "n": n, "single": (n == 1).astype(np.int64), "one": np.ones_like(n)}


def party_arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All parties of a batch of ``PARTIES``."""
    block = column(batch, "block")
    rows = batch.filter(pa.compute.is_null(block))
    packed = unpacked(block, len(PARTY_COLUMNS))
    return {c: np.r_[column(rows, c).to_numpy(zero_copy_only=False).astype(np.int64), x] for c, x in zip(PARTY_COLUMNS, packed, strict=True)}


def task_sums(pairs: DataFrame, common: int, sums: dict[str, tuple[str, str]], arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> DataFrame:
    """(word, sums): name -> (side, column) is the sum of the column over the task's pairs with the word on that side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((len(sums), common), dtype=np.int64)

        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = arrays(batch)
                at = {side: held[side] for side in ("word", "context")}
                rest = {side: np.flatnonzero(x >= common) for side, x in at.items()}
                cells = np.zeros((1 + len(sums), sum(map(len, rest.values()))), dtype=np.int64)
                cells[0] = np.concatenate([x[rest[side]] for side, x in at.items()])
                for k, (side, name) in enumerate(sums.values()):
                    values = held[name]
                    mine = slice(0, len(rest["word"])) if side == "word" else slice(len(rest["word"]), None)
                    cells[1 + k, mine] = values[rest[side]]
                    if common:
                        ours = at[side] < common
                        np.add.at(dense[k], at[side][ours], values[ours])
                yield cells

        for cells in chunks(found()):
            order = np.argsort(cells[0])
            cells = cells[:, order]
            first = np.flatnonzero(np.diff(cells[0], prepend=-1))
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(cells[0, first]), *map(pa.array, np.add.reduceat(cells[1:], first, axis=1))], names=names)
        seen = np.flatnonzero(dense.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, dense[:, seen])], names=names)

    names = ["word", *sums]
    return pairs.transform(arrow, run, ", ".join(f"{c} long" for c in names))


def reseat(parties: DataFrame, words: DataFrame, rest: Restaurants, common: int, sweep: int, keep: bool, seed: int) -> DataFrame:
    """One sweep over all parties; with ``keep`` its tables are added to the sums."""
    columns = ("customers", "seats", "tables")
    shared = parties.sparkSession.sparkContext.broadcast((rest, coded(words, common, columns)))

    def drawn(r: Restaurants, logs: np.ndarray, held: dict[str, np.ndarray], of: Callable[[str, str], np.ndarray]) -> list[np.ndarray]:
        word, context, n, tables, kept = (held[c] for c in PARTY_COLUMNS)
        parents = of("word", "customers") - tables
        seats = np.minimum(of("word", "seats"), parents)
        base = ((parents - r.root_discount * seats + (r.root_strength + r.root_discount * r.root_tables[-1]) * r.uniform)
                / (r.root_strength + r.root_customers[-1] - tables))
        tables = draw_tables(n, base, of("context", "tables") - tables, r.strength, r.discount, logs, (seed, sweep, word, context))
        return [word, context, n, tables, kept + tables if keep else kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, known = shared.value
        logs = stirling_logs(r.discount)
        for batch in batches:
            if batch.num_rows:
                found = drawn(r, logs, {c: column(batch, c).to_numpy() for c in PARTY_COLUMNS}, partial(looked_up, batch, coded=known, common=common))
                yield party_rows(found)

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, known = shared.value
        logs = stirling_logs(r.discount)
        for batch in batches:
            for block in column(batch, "block"):
                held = dict(zip(PARTY_COLUMNS, unpack(block.as_buffer(), len(PARTY_COLUMNS)), strict=True))
                yield party_block(drawn(r, logs, held, lambda side, name, held=held: known[name][held[side]]))

    def run_mixed(left: pa.Table, right: pa.Table) -> pa.Table:
        r, known = shared.value
        logs = stirling_logs(r.discount)
        rare = RareWords(right, columns)
        out = []
        for block in left.column("block"):
            held = dict(zip(PARTY_COLUMNS, unpack(block.as_buffer(), len(PARTY_COLUMNS)), strict=True))
            at = rare.places(held["word"], held["context"], common)

            def of(side: str, name: str, held=held, at=at) -> np.ndarray:
                return rare.of(name, held[side], at, known, common)

            out.append(party_block(drawn(r, logs, held, of), bucket=left.column("bucket")[0].as_py()))
        release()
        return pa.Table.from_batches(out, party_block([], None).schema)

    blocks, packed = parties.select("bucket", "block"), F.col("block").isNotNull()
    words_of = rare_words(words.select("word", *columns), common, buckets_for(rest.tokens))
    return reduce(DataFrame.unionByName, [
        blocks.where(packed & F.col("bucket").isNull()).select("block").transform(arrow, run_blocks, PARTIES),
        blocks.where(packed & F.col("bucket").isNotNull()).groupBy("bucket").cogroup(words_of.groupBy("bucket")).applyInArrow(run_mixed, PARTIES),
        with_words(parties.where(~packed).drop("bucket", "block"), words, common, columns).transform(arrow, run, PARTIES)])


class RareWords:
    """The columns of a bucket's words without a code, from blocks of ``rare_words``; 0 for unknown words."""

    def __init__(self, blocks: pa.Table, columns: tuple[str, ...]):
        found = blocks_of(blocks, RARE_WORDS, 1 + len(columns))
        found = np.concatenate([found, np.zeros_like(found, shape=(len(found), 1))], axis=1)  # last, an unknown word
        found[0, -1] = np.iinfo(np.int64).max
        found = found[:, np.argsort(found[0])]
        self.words, self.columns = found[0], dict(zip(columns, found[1:], strict=True))

    def places(self, word: np.ndarray, context: np.ndarray, common: int) -> np.ndarray:
        """Where the words of pairs are that have no code; of two such words the former's."""
        key = np.where(word >= common, word, context)
        i = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[i] == key, i, len(self.words) - 1)

    def of(self, name: str, side: np.ndarray, at: np.ndarray, known: dict[str, np.ndarray], common: int) -> np.ndarray:
        """A column of the words on one side of the pairs at these places; coded words are looked up in ``known``."""
        rare = side >= common
        return np.where(rare, self.columns[name][at], known[name][np.where(rare, 0, side)])


def party_rows(arrays: list[np.ndarray]) -> pa.RecordBatch:
    n = len(arrays[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *map(pa.array, arrays), pa.nulls(n, pa.binary())], names=["bucket", *PARTY_COLUMNS, "block"])


def party_block(arrays: list[np.ndarray], bucket: int | None = None) -> pa.RecordBatch:
    none = [pa.nulls(1, pa.int64()) for _ in PARTY_COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *none, pa.array([pack(*arrays) if arrays else b""], pa.binary())], names=["bucket", *PARTY_COLUMNS, "block"])


def first_parties(pairs: DataFrame, common: int, buckets: int) -> DataFrame:
    """The parties of two customers or more, each at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                held = unpacked(column(batch, "block"), 3)
                yield held[:, held[2] > 1]

        for held in chunks(found(), KEPT):
            held = np.concatenate([held, np.ones_like(held[:1]), np.zeros_like(held[:1])])
            kind = kind_of(held[0], held[1], common)
            if (kind == NEAR).any():
                yield party_block(list(held[:, kind == NEAR]))
            mixed = held[:, kind == MIXED]
            bucket = bucket_of(mixed[0], mixed[1], common, buckets)
            for at in np.unique(bucket):
                yield party_block(list(mixed[:, bucket == at]), int(at))
            if (kind == BARE).any():
                yield party_rows(list(held[:, kind == BARE]))

    return pairs.select("block").transform(arrow, run, PARTIES)


def reseat_root(parties: DataFrame, words: DataFrame, rest: Restaurants, common: int, sweep: int, seed: int) -> DataFrame:
    """The words' sums over newly seated parties, and the root's seating of the new customers."""
    shared = parties.sparkSession.sparkContext.broadcast(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Restaurants = shared.value
        logs = stirling_logs(r.root_discount)
        for batch in batches:
            if not batch.num_rows:
                continue
            word, customers, seats = (column(batch, c).to_numpy() for c in ("word", "customers", "seats"))
            drawn = draw_tables(customers, np.full(len(word), r.uniform), r.root_tables[-1] - seats, r.root_strength, r.root_discount, logs, (seed, sweep, word, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(drawn)], names=batch.schema.names)

    none = [F.lit(0).cast("long").alias(c) for c in ("n", "fixed", "fixed_tables", "seats")]
    cells = (task_sums(parties, common, {"customers": ("word", "tables"), "tables": ("context", "tables")}, party_arrays).select("*", *none)
             .unionByName(words.select("word", F.col("fixed").alias("customers"), F.col("fixed_tables").alias("tables"), "n", "fixed", "fixed_tables", "seats")))
    sums = cells.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "fixed", "fixed_tables", "customers", "tables", "seats")])
    return sums.transform(arrow, run, WORDS)


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


@dataclass
class Model:
    """parties: all parties of two customers or more; counted: blocks of all pairs' counts; words: (word, n, and per kept
    sweep customers and seats in the root, tables of its restaurant)."""
    parties: DataFrame
    counted: DataFrame
    words: DataFrame
    codes: Codes
    restaurants: Restaurants
    kept: list[int]

    def weighed(self, run: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], schema: str, coded: bool | None = None) -> DataFrame:
        """The rows that ``run`` makes of arrays (word, context, n, weight as its bits); weight: the customers less the discount of their mean tables.

        coded: only pairs of two coded words, or only the others.
        """
        discount, samples = self.restaurants.discount, len(self.kept)

        def parties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[np.ndarray]:
                for batch in batches:
                    held = party_arrays(batch)
                    yield np.stack([held["word"], held["context"], held["n"], (held["n"] - discount * held["kept"] / samples).view(np.int64)])

            return run(found())

        def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[np.ndarray]:
                for batch in batches:
                    held = unpacked(column(batch, "block"), 3)
                    held = held[:, held[2] == 1]
                    yield np.concatenate([held, np.full((1, held.shape[1]), 1 - discount).view(np.int64)])

            return run(found())

        found = (self.parties, F.col("block").isNotNull() & F.col("bucket").isNull()), (self.counted, F.col("coded"))
        many, ones = (rows if coded is None else rows.where(c if coded else ~c) for rows, c in found)
        return many.transform(arrow, parties, schema).unionByName(ones.select("block").transform(arrow, singles, schema))

    @property
    def pairs(self) -> DataFrame:
        """(word, context, n, weight), a row each."""

        def run(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for word, context, n, weight in found:
                yield pa.RecordBatch.from_arrays([*map(pa.array, (word, context, n, weight.view(np.float64)))], names=["word", "context", "n", "weight"])

        return self.weighed(run, "word long, context long, n long, weight double")

    def unknown_root(self) -> np.ndarray:
        return np.array([self.restaurants.root(0, 0, k) for k in self.kept])

    # For small models: the whole of them as one row per word, restaurants numbered in the order of their words' codes.

    def escapes(self) -> np.ndarray:
        """(kept sweeps, restaurants)"""
        customers, tables = self.restaurants.read()
        return self.restaurants.escape(customers, tables)

    @property
    def rows(self) -> DataFrame:
        """(word, n, contexts, own, root): its probability ``own`` in the restaurants that served it, ``root`` in the root by sweep."""
        rest = self.restaurants
        number = self.words.select(F.col("word").alias("context"), F.col("n").alias("_c"), (F.row_number().over(Window.orderBy("word")) - 1).alias("contexts"))
        own = self.pairs.join(number, "context").select("word", F.struct("contexts", (F.col("weight") / (rest.strength + F.col("_c"))).alias("own")).alias("cell"))
        own = own.groupBy("word").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
        root = F.array(*[rest.root(F.get("customers", F.lit(i)), F.get("seats", F.lit(i)), k) for i, k in enumerate(self.kept)])
        return self.words.join(own, "word").select("word", "n", F.col("cells.contexts").alias("contexts"), F.col("cells.own").alias("own"), root.alias("root"))


def learn(docs: DataFrame, text_col: str = "text", burn: int = 3, samples: int = 3, seed: int = 1, most_common: int = MOST_COMMON) -> Model:
    """The model of all rows of ``docs``."""
    codes = common_words(docs, text_col, most_common)
    common = len(codes)
    pairs = staged(pair_counts(docs, codes, text_col), "pairs")
    one = F.lit(1).cast("long")
    # To begin with every party has one table, and every word one in the root.
    sums = {"n": ("word", "n"), "fixed": ("word", "single"), "fixed_tables": ("context", "single"), "customers": ("word", "one"), "tables": ("context", "one")}
    cells = task_sums(pairs.select("block"), common, sums, pair_arrays)
    first = staged(cells.groupBy("word").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("seats", one), "words")

    def total(rows: DataFrame, **sums) -> dict[str, int]:
        return {c: x or 0 for c, x in rows.agg(*[F.sum(F.col(c).cast("long") if s is None else s.cast("long")).alias(c) for c, s in sums.items()]).first().asDict().items()}

    n, customers = F.col("n"), F.col("customers")
    sizes = total(pairs, ones=None, twos=None)
    t = total(first, n=None, words=one, alone=n == 1, customers=None, single=customers == 1, double=customers == 2)
    rest = Restaurants(discount_of(sizes["ones"], sizes["twos"]), discount_of(t["single"], t["double"]), t["n"], t["words"],
                       root_customers=[t["customers"]], root_tables=[t["words"]])
    # A word that occurs once has one customer at one table, in its context and in the root, in every seating; so has a pair, in its context.
    words = first.where("n > 1")
    parties = staged(first_parties(pairs, common, buckets_for(rest.tokens)), "seating")
    frames: list[tuple[int, DataFrame]] = []
    for sweep in range(burn + samples):
        seated = staged(reseat(parties, words, rest, common, sweep, sweep >= burn, seed), "seating")
        served = staged(reseat_root(seated, words, rest, common, sweep, seed), "served")
        new = total(served, customers=None, seats=None)
        drop_stage(parties)
        if 0 < sweep <= burn:
            drop_stage(words)
        rest.root_customers.append(new["customers"] + t["alone"])
        rest.root_tables.append(new["seats"] + t["alone"])
        parties, words = seated, served
        if sweep >= burn:
            frames.append((sweep + 1, words))
    kept = [k for k, _ in frames]
    lists = ("customers", "seats", "tables")
    swept = reduce(DataFrame.unionByName, [w.select("word", "n", F.lit(k).alias("k"), *lists) for k, w in frames])
    swept = swept.groupBy("word").agg(F.max("n").alias("n"), *[F.array(*[F.max(F.when(F.col("k") == k, F.col(c))) for k in kept]).alias(c) for c in lists])
    alone = first.where("n = 1").select("word", "n", *[F.array_repeat(one, samples).alias(c) for c in lists])
    model_words = staged(swept.unionByName(alone), "words")
    for _, w in frames:
        drop_stage(w)
    drop_stage(first)
    def read() -> tuple[np.ndarray, np.ndarray]:
        got = model_words.select("word", "n", "tables").toPandas().sort_values("word")
        return got["n"].to_numpy(), np.stack(got["tables"].to_list()).T if len(got) else np.zeros((samples, 0), np.int64)

    rest.read = read
    return Model(parties, pairs, model_words, codes, rest, kept)


# --- scoring -------------------------------------------------------------------------------

@dataclass
class Lookup:
    """What scoring holds in place: the first ``common`` codes, and the pairs of two of them that occur most often."""
    codes: Codes
    common: int
    words: dict[str, np.ndarray]
    root: np.ndarray
    escape: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    restaurants: Restaurants
    kept: list[int]
    smooth: float
    buckets: int
    #: Built where pairs are first looked up.
    index: Index | None = None

    def places(self, keys: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = Index(self.keys)
        return self.index.find(keys)

    def log(self, word: np.ndarray, context: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """log10 probabilities of coded words after coded words."""
        parent = np.zeros(len(word))
        for root, escape in zip(self.root, self.escape, strict=True):
            parent += root[word] * escape[context]
        return np.log10(weight / (self.restaurants.strength + self.words["n"][context]) + parent / len(self.root))


def lookup_of(model: Model, most_common: int, most_pairs: int) -> Lookup:
    rest, common = model.restaurants, min(most_common, len(model.codes))
    flat = flat_words(model)
    words = coded(flat, common, tuple(flat.columns[1:]))
    root = np.stack([rest.root(words[f"customers{i}"], words[f"seats{i}"], k) for i, k in enumerate(model.kept)])
    escape = np.stack([rest.escape(words["n"], words[f"tables{i}"]) for i in range(len(model.kept))])
    sizes = pair_sizes(model, common)
    keys, weights = frequent_pairs(model, common, least_count(sizes, most_pairs, F.col("k")))
    return Lookup(model.codes, common, words, root, escape, keys, weights, replace(rest, read=None), model.kept,
                  float(np.log10(rest.tokens + 0.5 * (rest.words + 1))), buckets_for(rest.tokens))


def flat_words(model: Model) -> DataFrame:
    """word, n, customers0, ..., seats0, ..., tables0, ..."""
    return model.words.select("word", "n", *[F.get(c, F.lit(i)).alias(f"{c}{i}") for c in ("customers", "seats", "tables") for i in range(len(model.kept))])


def pair_sizes(model: Model, common: int) -> DataFrame:
    """(n, k): k pairs of two of the first ``common`` codes occur n times; several rows of one n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, context, n = unpacked(column(batch, "block"), 3)
            n, k = np.unique(n[(word < common) & (context < common)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k)], names=["n", "k"])

    return model.counted.where("coded").select("block").transform(arrow, run, "n long, k long")


def frequent_pairs(model: Model, common: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and weights of the pairs of two of the first ``common`` codes that occur at least ``least`` times."""

    def run(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for word, context, n, weight in found:
            mine = (word < common) & (context < common) & (n >= least)
            yield pa.RecordBatch.from_arrays([pa.array(word[mine] << SHIFT | context[mine]), pa.array(weight[mine].view(np.float64).astype(np.float32))], names=["key", "weight"])

    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    got = fetched(model.weighed(run, "key long, weight float", coded=True))
    order = np.argsort(got["key"])
    return got["key"][order], got["weight"][order]


#: What the first pass of scoring writes.
PLACED = {"row": pa.int64(), "doc_id": pa.int64(), "bucket": pa.int64(), "word": pa.int64(), "context": pa.int64(), "block": pa.binary(), "mixed": pa.binary(),
          "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "log": pa.float64()}
SQL_TYPES = {pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
#: Pairs of two words with codes, of one, of none; and words without a code.
NEAR, MIXED, BARE, RARE_WORDS = range(4)


def kind_of(word: np.ndarray, context: np.ndarray, common: int) -> np.ndarray:
    return (word >= common).astype(np.int64) + (context >= common)


def model_pairs(model: Model, common: int, buckets: int, kind: int) -> DataFrame:
    """(bucket, kind, block): the pairs of a kind, (key, weight) of ``NEAR`` ones, else (word, context, weight)."""

    def run(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        def mine() -> Iterator[np.ndarray]:
            for word, context, _, weight in found:
                ours = kind_of(word, context, common) == kind
                yield np.stack([word[ours], context[ours], weight[ours]])

        for word, context, weight in chunks(mine(), PAIRS // 2):
            bucket = bucket_of(word, context, common, buckets)
            order = np.argsort(bucket << 2 * SHIFT | word << SHIFT | context) if kind == NEAR else bucket_order(bucket, buckets)
            word, context, weight = word[order], context[order], weight[order]
            yield from block_rows(by_bucket(bucket[order], (word << SHIFT | context, weight) if kind == NEAR else (word, context, weight)))

    coded = True if kind == NEAR else False if common == len(model.codes) else None
    return model.weighed(run, "bucket long, block binary", coded).withColumn("kind", F.lit(kind))


def rare_words(flat: DataFrame, common: int, buckets: int) -> DataFrame:
    """(bucket, kind, block): the columns of the words that are not looked up in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                yield np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])

        for words in chunks(found(), PAIRS // 8):
            bucket = bucket_of(words[0], words[0], common, buckets)
            order = bucket_order(bucket, buckets)
            yield from block_rows(by_bucket(bucket[order], tuple(words[:, order])))

    return flat.where(F.col("word") >= common).transform(arrow, run, "bucket long, block binary").withColumn("kind", F.lit(RARE_WORDS))


def blocks_of(table: pa.Table, kind: int, arrays: int) -> np.ndarray:
    return unpacked(table.filter(pa.compute.equal(table.column("kind"), kind)).column("block"), arrays)


def row_blocks(row: np.ndarray, *sums: np.ndarray) -> pa.Table:
    """(bucket, block) by text: (row, sums of known, base, log), a number per text."""
    order = np.argsort(row)
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    sums = tuple(np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums)
    blocks = list(by_bucket(row[first] >> ROWS, (row[first], *sums)))
    release()
    return pa.table({"bucket": pa.array([b for b, _ in blocks], pa.int64()), "block": pa.array([d for _, d in blocks], pa.binary())})


def with_rare(rows: DataFrame, blocks: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Tokens of pairs with a word without a code meet the model's blocks of their bucket, in which all pairs of that word lie.

    Words without a code have few occurrences, so none is a hot key.
    """
    return rows.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(lambda left, right: run(left, right), "bucket long, block binary")


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most_common: int = MOST_COMMON, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per row: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``docs`` is read once. Tokens that are not looked up in place are written once, and meet the model bucket by bucket
    (of which there are as many as the training texts need).
    """
    rest = model.restaurants
    shared = docs.sparkSession.sparkContext.broadcast(lookup := lookup_of(model, most_common, most_pairs))
    common, buckets = lookup.common, lookup.buckets
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the sums over what is looked up in place; of other tokens blocks: (key, row) if they and the word before are coded, (row, word, context) if one is; else a row each."""
        at: Lookup = shared.value
        base = np.log10(at.words["n"] + 0.5) - at.smooth
        held: list[np.ndarray] = []
        mixed: list[np.ndarray] = []

        def rows_of(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in PLACED.items()], names=list(PLACED))

        def blocks() -> Iterator[pa.RecordBatch]:
            key, row = np.concatenate(held, axis=1)
            held.clear()
            bucket = bucket_of(key >> SHIFT, key & FIRST - 1, at.common, at.buckets)
            order = np.argsort(bucket << 2 * SHIFT | key)
            for batch in block_rows(by_bucket(bucket[order], (key[order], row[order]))):
                yield rows_of(bucket=batch.column(0), block=batch.column(1))

        def mixed_blocks() -> Iterator[pa.RecordBatch]:
            row, word, context = np.concatenate(mixed, axis=1)
            mixed.clear()
            bucket = bucket_of(word, context, at.common, at.buckets)
            order = bucket_order(bucket, at.buckets)
            for batch in block_rows(by_bucket(bucket[order], (row[order], word[order], context[order]))):
                yield rows_of(bucket=batch.column(0), mixed=batch.column(1))

        for batch in batches:
            for part in steps(batch):
                texts = strings(part)
                row = column(part, "row").to_numpy()
                sums = np.zeros((4, len(texts)))
                for word, context, text in at.codes.runs(texts):
                    ours = word < at.common
                    both = ours & (context < at.common)
                    w, u, t = word[both], context[both], text[both]
                    key = w << SHIFT | u
                    i = at.places(key)
                    hit = i >= 0
                    log = at.log(w[hit], u[hit], at.weights[i[hit]])
                    for k, (x, y) in enumerate(((text, None), (text[ours], None), (text[ours], base[word[ours]]), (t[hit], log))):
                        sums[k] += np.bincount(x, y, minlength=len(texts))
                    held.append(np.stack([key[~hit], row[t[~hit]]]))
                    bare = ~ours & (context >= at.common)
                    one = ~both & ~bare
                    mixed.append(np.stack([row[text[one]], word[one], context[one]]))
                    if sum(x.shape[1] for x in mixed) >= PAIRS // 4:
                        yield from mixed_blocks()
                    w, u = word[bare], context[bare]
                    if len(w):
                        yield rows_of(row=pa.array(row[text[bare]]), word=pa.array(w), context=pa.array(u), bucket=pa.array(bucket_of(w, u, at.common, at.buckets)))
                    if sum(x.shape[1] for x in held) >= PAIRS // 2:
                        yield from blocks()
                yield rows_of(row=pa.array(row), doc_id=column(part, "doc_id"),
                              **{c: pa.array(x.astype(np.int64) if c[:2] == "n_" else x) for c, x in zip(("n_tokens", "n_known", "base", "log"), sums, strict=True)})
        if held:
            yield from blocks()
        if mixed:
            yield from mixed_blocks()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        at: Lookup = shared.value
        key, row = unpacked(left.column("block"), 2)
        keys, weights = blocks_of(right, NEAR, 2)
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order].view(np.float64)
        weight = np.zeros(len(key))
        if len(keys):
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            weight = np.where(keys[i] == key, weights[i], 0.0)
        none = np.zeros(len(row))
        return row_blocks(row, none, none, at.log(key >> SHIFT, key & FIRST - 1, weight))

    def far(left: pa.Table, right: pa.Table, kind: int) -> pa.Table:
        """The parent's probability of every token, its share of a customer, the pair's weight; what the base needs of words without a code."""
        at: Lookup = shared.value
        r = at.restaurants
        names = list(at.words)
        row, word, context = (left.column(c).to_numpy() for c in ("row", "word", "context"))
        found = RareWords(right, tuple(names))
        rare = word >= at.common
        i = found.places(word, context, at.common)

        def of(side: str, name: str) -> np.ndarray:
            if side == "context" and kind == BARE:
                return pa.compute.fill_null(left.column(f"context_{name}"), 0).to_numpy()
            return found.of(name, word if side == "word" else context, i, at.words, at.common)

        weight = np.zeros(len(row))
        words, contexts, weights = blocks_of(right, kind, 3)
        if len(words):
            pair, pairs = (spread(spread(w.view(np.uint64)) + u.view(np.uint64)) for w, u in ((word, context), (words, contexts)))
            order = np.argsort(pairs)
            j = order[np.minimum(np.searchsorted(pairs, pair, sorter=order), len(pairs) - 1)]
            weight = np.where((words[j] == word) & (contexts[j] == context), weights[j].view(np.float64), 0.0)
        before = of("context", "n")
        parent = sum(r.root(of("word", f"customers{k}"), of("word", f"seats{k}"), s) * r.escape(before, of("context", f"tables{k}")) for k, s in enumerate(at.kept))
        share, parent = (x.astype(np.float32).astype(float) for x in (1 / (r.strength + before), parent / len(at.kept)))
        log = np.log10(weight * share + parent)
        n = of("word", "n")
        return row_blocks(row, np.where(rare & (n > 0), 1.0, 0.0), np.where(rare, np.log10(n + 0.5) - at.smooth, 0.0), log)

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The sums of every text of a bucket."""
        first = key[0].as_py() << ROWS
        sums = np.zeros((3, 1 << ROWS))
        seen = np.zeros(1 << ROWS, dtype=bool)
        for chunk in table.column("block").chunks:
            for block in chunk:
                row, *found = unpack(block.as_buffer(), 4)
                at = row - first
                seen[at] = True
                for total, x in zip(sums, found, strict=True):
                    total[at] += x.view(np.float64)  # the texts of a block are distinct
        at = np.flatnonzero(seen)
        return pa.table({"row": pa.array(at + first), **{c: pa.array(x[at]) for c, x in zip(("_known", "_base", "_log"), sums, strict=True)}})

    rows = staged(numbered.transform(arrow, place, ", ".join(f"{c} {SQL_TYPES[t]}" for c, t in PLACED.items())), "scored")
    flat = flat_words(model)
    columns = tuple(flat.columns[1:])
    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, block in zip(column(batch, "bucket"), column(batch, "mixed"), strict=True):
                held = unpack(block.as_buffer(), 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(held.shape[1], bucket.as_py())), *map(pa.array, held)], names=["bucket", "row", "word", "context"])

    far_tokens = {MIXED: rows.where(F.col("mixed").isNotNull()).select("bucket", "mixed").transform(arrow, tokens_of, "bucket long, row long, word long, context long"),
                  BARE: rows.where(F.col("word").isNotNull()).select("bucket", "row", "word", "context")}
    parts = []
    for k in range(FAR_ROUNDS):
        turn = partial(in_round, k=k, rounds=FAR_ROUNDS)
        for kind in (MIXED, BARE):
            tokens = far_tokens[kind].where(turn(F.col("bucket")))
            if kind == BARE:
                tokens = with_word(tokens, flat, common, columns, F.col("context"), "context")
            blocks = model_pairs(model, common, buckets, kind).unionByName(rare_words(flat, common, buckets)).where(turn(F.col("bucket")))
            parts.append(staged(with_rare(tokens, blocks, partial(far, kind=kind)), "far"))
    for k in range(NEAR_ROUNDS):
        turn = in_round(F.col("bucket"), k, NEAR_ROUNDS)
        tokens = rows.where(F.col("block").isNotNull() & turn).select("bucket", "block")
        parts.append(staged(tokens.groupBy("bucket").cogroup(model_pairs(model, common, buckets, NEAR).where(turn).groupBy("bucket")).applyInArrow(
            lambda left, right: near(left, right), "bucket long, block binary"), "near"))
    texts = staged(rows.where(F.col("n_tokens").isNotNull()).select("row", "doc_id", "n_tokens", "n_known", "base", "log"), "texts")
    drop_stage(rows)
    sums = staged(reduce(DataFrame.unionByName, parts).groupBy("bucket").applyInArrow(added, "row long, _known double, _base double, _log double"), "sums")
    for part in parts:
        drop_stage(part)
    known, base, log = (F.coalesce(c, F.lit(0.0)) for c in ("_known", "_base", "_log"))
    score = F.col("log") + log
    return (texts.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + known.cast("long")).alias("n_known"), F.lit(rest.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + base).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity")))


def perplexity(scored: DataFrame, by: str) -> DataFrame:
    """(by, n_tokens, perplexity of the model, of the base) over all texts of each value of ``by``."""
    sums = scored.groupBy(by).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("_s"), F.sum("base_score").alias("_b"))
    return sums.select(by, "n_tokens", *[F.pow(F.lit(10.0), -F.col(c) / F.col("n_tokens")).alias(a) for c, a in (("_s", "perplexity"), ("_b", "base_perplexity"))])


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by a hierarchical Pitman-Yor model of the texts that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    fold = fold_of("doc_id", 5)
    scored = score_texts(docs, learn(docs.where((fold >= 0) & (fold != 1))))
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
