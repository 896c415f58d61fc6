"""Language identification by averaged hashed subword embeddings and a linear softmax.

Texts are reduced to lower-case letters with one blank for each other character. Character
n-grams of 2 to 4 are hashed into ``BUCKETS`` rows of an embedding; a text is the mean of its rows,
and a linear softmax gives the classes. Embedding and softmax are trained together by stochastic
gradient descent in numpy, on the driver, on a bounded sample: ``train_rows`` rows, the
languages in equal shares, those with the smallest hashes of the id, whole texts and short pieces of them, 64 MB
at most (a text of over a quarter of a language's share of that is passed over).
For prediction both fold into one table of class scores per bucket, so each whole text is one
gather and one sum.

A temperature, fitted on the tenth of the sample kept apart, calibrates the probabilities; the
least threshold at which the accepted part of that tenth reaches ``accept`` accuracy
gives ``rejected``. A null text, one without letters, or a corpus without any labelled language gives
``und`` with score 0. Rows with a null id or null language are never learned from. Rows are
predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, code_points, column, fold_of, hash_sample, letter_table, read_table, spread, steps, strings

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, 0 for every other character."""
    return letter_table(digits=False)[code_points(text)]


def subwords(symbols: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    n = len(symbols) - order + 1
    h = np.full(max(n, 0), order, dtype=np.uint64)
    for i in range(order):
        h = h * np.uint64(0x100000001B3) + symbols[i:i + n]
    return (spread(h) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(text: str) -> np.ndarray:
    symbols = np.concatenate([[0], letters_of(text), [0]]).astype(np.uint32)
    return np.concatenate([subwords(symbols, n)[symbols[:max(0, len(symbols) - n + 1)] > 0] if n > 2 else subwords(symbols, n) for n in ORDERS]).astype(np.uint16)


class LanguageModel:
    """Class scores per bucket, with calibration."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table, bias, temperature, least

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, whether a text has a letter): all texts of a step at once."""
        marked = [letters_of(t) for t in texts]
        some = np.array([m.any() for m in marked], dtype=bool)
        sums = np.zeros((len(texts), len(self.langs)), dtype=np.float64)
        counts = np.zeros(len(texts), dtype=np.float64)
        sizes = np.array([len(m) + 2 for m in marked], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        symbols = np.zeros(int(sizes.sum()), dtype=np.uint32)
        for m, s in zip(marked, starts, strict=True):
            symbols[s + 1:s + 1 + len(m)] = m
        for n in ORDERS:
            at = subwords(symbols, n)
            if not len(at):
                continue
            used = np.ones(len(at), dtype=np.float32) if n == 2 else (symbols[:len(at)] > 0).astype(np.float32)
            ends = starts + sizes
            for d in range(1, n):  # n-grams do not run into the next text
                last = ends - d
                used[last[last < len(used)]] = 0
            # ``starts`` ascend and every text has at least its two blanks.
            begin = np.minimum(starts, len(at) - 1)
            sums += np.add.reduceat(self.table[at] * used[:, None], begin, axis=0, dtype=np.float64)
            counts += np.add.reduceat(used, begin, dtype=np.float64)
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), some


def train(texts: list[str], langs: list[str], accept: float = 0.99, epochs: int = 4, rate: float = 12.0, seed: int = 7) -> LanguageModel | None:
    """Embedding and softmax by stochastic gradient descent, mini-batches of 32 texts."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])
    apart = rng.random(len(texts)) < 0.1
    rows: list[tuple[np.ndarray, int]] = []
    for text, y, out in zip(texts, label, apart, strict=True):
        if out:
            continue
        rows.append((features(text), y))
        for size in (40, 200):
            if len(text) > 2 * size:
                i = int(rng.integers(0, len(text) - size))
                rows.append((features(text[i:i + size]), y))
    rows = [r for r in rows if len(r[0])]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    total = epochs * len(rows)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 32):
            batch = [rows[j] for j in order[i:i + 32]]
            sizes = np.array([len(f) for f, _ in batch])
            at = np.concatenate([f for f, _ in batch])
            y = np.array([c for _, c in batch])
            mean = np.add.reduceat(emb[at], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            step = rate * (1 - done / total) / 32
            back = (p @ out.T / sizes[:, None]).astype(np.float32)
            out -= step * 0.1 * mean.T @ p
            bias -= step * 0.1 * p.sum(axis=0)
            who = np.repeat(np.arange(len(batch)), sizes)
            uniq, inverse = np.unique(at, return_inverse=True)
            flat = np.zeros((len(uniq), DIM), dtype=np.float32)
            for d in range(DIM):
                flat[:, d] = np.bincount(inverse, weights=back[who, d], minlength=len(uniq))
            emb[uniq] -= step * 40 * flat
            done += len(batch)
    model = LanguageModel(names, emb @ out, bias, 1.0, 0.0)
    held = [(t, y) for t, y, a in zip(texts, label, apart, strict=True) if a and letters_of(t).any()]
    if held:
        p, _ = model.scores([t for t, _ in held])
        y = np.array([c for _, c in held])
        logp = np.log(p + 1e-30)

        def loss(temperature: float) -> float:
            q = logp / temperature
            q = q - np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - q.max(axis=1, keepdims=True)
            return -float(q[np.arange(len(y)), y].mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p, _ = model.scores([t for t, _ in held])
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= accept)
        model.least = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def training_sample(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> pd.DataFrame:
    """Of every language its equal share of ``rows`` labelled rows, the smallest hashes of the id, at most 64 MB of text; equal texts once."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    picked = hash_sample(known, counts, rows / len(counts), group="lang").select("hash", "text", F.col("group").alias("lang")).toPandas()
    return picked.sort_values(["hash", "lang", "text"]).drop_duplicates("text").reset_index(drop=True)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 3000,
             accept: float = 0.99) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score, rejected."""
    spark = docs.sparkSession
    sample = training_sample(docs, train_rows, id_col, text_col, lang_col)
    model = spark.sparkContext.broadcast(train(list(sample["text"]), list(sample["lang"]), accept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in steps(batch):
                n = part.num_rows
                lang, score, rejected = np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, dtype=bool)
                if m is not None:
                    p, some = m.scores(strings(part))
                    lang[some] = np.array(m.langs, dtype=object)[p.argmax(axis=1)[some]]
                    score[some] = p.max(axis=1)[some]
                    rejected[some] = score[some] < m.least
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "held_out"), pa.array(lang, pa.string()), pa.array(score),
                                                  pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(arrow, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by averaged hashed subword embeddings, with calibrated rejection."""
    return identify(read_table(spark, sf_dir, "documents"))
