"""Toxicity by a linear-chain conditional random field over words.

The field has two states per word (ordinary, toxic). Word labels come from document labels: in a
toxic document the words of a lexicon are toxic, all other words are ordinary. The lexicon holds the
words that a fiftieth of the toxic documents have, and ``LIFT`` times the share of the others, near
copies counted once. The field's weights (word, previous word, next word, transitions) maximise the likelihood of
those label sequences, by full-batch gradient steps over forward-backward marginals in numpy. A
logistic curve over the marginals, fitted on a quarter of the sample kept apart, gives the document's score.

Learning uses a bounded sample, ``train_rows`` rows, half of each label, those with the smallest hashes of the id,
from rows with a label, an id and crc32(id) mod 5 other than 0; their texts hold 64 MB at most (of over 8 MB none is drawn). Scoring reads every whole
text, from the text alone, without a shuffle. Marginals of a text of any length are exact: chunks of 32
words are multiplied out side by side, then joined from chunk to chunk.

A null, empty or wordless text gets the curve's value for no toxic word. With no labelled rows, or
of one kind only, every score is the share of toxic labels (0 without labels). Of several labels for an
id the largest counts. Rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, column, fold_of, hash_limit, hash_sample, read_table, small_batches, spread, steps, strings

WORD = re.compile(r"\w+")
#: Length of a chunk, words of the vocabulary, least lift and least document frequency of a lexicon word.
CHUNK, VOCABULARY, LIFT, LEAST_DOCS = 32, 50_000, 15.0, 4


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def marginals(emission: np.ndarray, sizes: np.ndarray, moves: np.ndarray, expected: bool = False):
    """Probability of the toxic state at every word.

    emission: log weight of the toxic state over the ordinary one, the sequences one after the other;
    sizes: words per sequence; moves[i, j]: weight of state j after state i. Before the first word
    the state is ordinary. With ``expected`` also the expected counts of the four moves and the
    log of the summed weights.
    """
    n_seq = len(sizes)
    chunks = -(-sizes // CHUNK)
    chunk_start = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    if not total:
        empty = np.zeros(0)
        return (empty, np.zeros((2, 2)), 0.0) if expected else empty
    within = np.arange(len(emission)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = np.repeat(chunk_start, sizes) + within // CHUNK, within % CHUNK
    f = np.ones((CHUNK, total))
    f[col, row] = np.exp(np.clip(emission, -30, 30))
    real = np.zeros((CHUNK, total), dtype=bool)
    real[col, row] = True
    (m00, m01), (m10, m11) = moves
    logs = np.zeros(total)

    # The product of each chunk's step matrices; steps past a sequence's end change nothing.
    q00, q01, q10, q11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for t in range(CHUNK):
        r = real[t]
        a00, a01 = q00 * m00 + q01 * m10, (q00 * m01 + q01 * m11) * f[t]
        a10, a11 = q10 * m00 + q11 * m10, (q10 * m01 + q11 * m11) * f[t]
        s = np.maximum(np.maximum(a00, a01), np.maximum(a10, a11))
        logs += np.where(r, np.log(s), 0)
        q00, q01 = np.where(r, a00 / s, q00), np.where(r, a01 / s, q01)
        q10, q11 = np.where(r, a10 / s, q10), np.where(r, a11 / s, q11)

    # From chunk to chunk, the sequences side by side, longest first.
    order = np.argsort(-chunks, kind="stable")
    counts = chunks[order]
    live = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left")  # sequences with more than k chunks
    in0, in1 = np.ones(total), np.zeros(total)
    out0, out1 = np.ones(total), np.ones(total)
    x0, x1 = np.ones(n_seq), np.zeros(n_seq)
    for k, n in enumerate(live):
        at = chunk_start[order[:n]] + k
        in0[at], in1[at] = x0[:n], x1[:n]
        y0, y1 = x0[:n] * q00[at] + x1[:n] * q10[at], x0[:n] * q01[at] + x1[:n] * q11[at]
        s = y0 + y1
        logs[at] += np.log(s)
        x0[:n], x1[:n] = y0 / s, y1 / s
    b0, b1 = np.ones(n_seq), np.ones(n_seq)
    for k in range(int(counts[0]) - 1, -1, -1):
        n = live[k]
        at = chunk_start[order[:n]] + k
        out0[at], out1[at] = b0[:n], b1[:n]
        y0, y1 = q00[at] * b0[:n] + q01[at] * b1[:n], q10[at] * b0[:n] + q11[at] * b1[:n]
        s = y0 + y1
        b0[:n], b1[:n] = y0 / s, y1 / s

    # Inside all chunks at once.
    back0, back1 = np.empty((CHUNK, total)), np.empty((CHUNK, total))
    b0, b1 = out0, out1
    for t in range(CHUNK - 1, -1, -1):
        back0[t], back1[t] = b0, b1
        y0, y1 = m00 * b0 + m01 * f[t] * b1, m10 * b0 + m11 * f[t] * b1
        s = y0 + y1
        b0, b1 = np.where(real[t], y0 / s, b0), np.where(real[t], y1 / s, b1)
    p = np.empty((CHUNK, total))
    seen = np.zeros((2, 2))
    x0, x1 = in0, in1
    for t in range(CHUNK):
        r = real[t]
        y0, y1 = x0 * m00 + x1 * m10, (x0 * m01 + x1 * m11) * f[t]
        z = y0 * back0[t] + y1 * back1[t]
        p[t] = y1 * back1[t] / z
        if expected:
            for i, x in enumerate((x0, x1)):
                seen[i, 0] += (x * moves[i, 0] * back0[t] / z)[r].sum()
                seen[i, 1] += (x * moves[i, 1] * f[t] * back1[t] / z)[r].sum()
        s = y0 + y1
        x0, x1 = np.where(r, y0 / s, x0), np.where(r, y1 / s, x1)
    return (p[col, row], seen, float(logs.sum())) if expected else p[col, row]


class ToxicityModel:
    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray, curve: np.ndarray):
        self.vocabulary, self.weights, self.moves, self.curve = vocabulary, weights, moves, curve

    def emission(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word, previous-word and next-word weights; id 0 stands for unknown words and borders."""
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        last = (np.cumsum(sizes) - 1)[sizes > 0]
        before[first], after[last] = 0, 0
        return self.weights[0][ids] + self.weights[1][before] + self.weights[2][after]

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words, words per text)."""
        get = self.vocabulary.get
        ids = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype=np.int64)
        return marginals(self.emission(flat, sizes), sizes, self.moves), sizes

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-evidence(p, sizes) @ self.curve))


def evidence(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: 1, the largest marginal, log of 1 + the expected number of toxic words."""
    out = np.zeros((len(sizes), 3))
    out[:, 0] = 1
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some, 1] = np.maximum.reduceat(p, starts)
        out[some, 2] = np.log1p(np.add.reduceat(p, starts))
    return out


def far_apart(words: list[np.ndarray], kept: int = 4, width: int = 5) -> np.ndarray:
    """False for a text that shares one of its least five-word hashes with an earlier text, a likely near copy.

    A group of near copies with one label would otherwise make all of its rare words look telling.
    """
    met: set[int] = set()
    out = np.ones(len(words), dtype=bool)
    for k, w in enumerate(words):
        n = max(0, len(w) - width + 1) or min(1, len(w))
        h = np.zeros(n, dtype=np.uint64)
        for i in range(min(width, len(w))):
            h = spread(h + w[i:i + n].astype(np.uint64))
        least = set(np.unique(h)[:kept].tolist())
        out[k] = not (least & met)
        met |= least
    return out


def train(texts: list[str], toxic: list[int], shares: tuple[float, float], seed: int = 11, rounds: int = 60) -> ToxicityModel:
    """The field on three quarters of the texts, the curve on the rest; shares: rows of each label in the whole corpus."""
    base = shares[1] / max(1e-9, sum(shares))
    flat_curve = np.array([np.log(max(base, 1e-6) / max(1 - base, 1e-6)), 0.0, 0.0])
    y = np.array(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, np.zeros((3, 1)), np.ones((2, 2)), flat_curve)
    rng = np.random.default_rng(seed)
    fit = rng.random(len(texts)) < 0.75
    number: dict[str, int] = {}
    words = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
    fit &= far_apart(words)
    docs, bad = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
    n_bad = max(1, int(y[fit].sum()))
    n_good = max(1, int(fit.sum()) - n_bad)
    for w, t, f in zip(words, y, fit, strict=True):
        if f:
            own = np.unique(w)
            docs[own] += 1
            bad[own] += t
    telling = (bad >= max(LEAST_DOCS, n_bad // 50)) & ((bad + 0.5) / n_bad >= LIFT * (docs - bad + 0.5) / n_good)
    names = np.array(list(number), dtype=object)
    common = np.lexsort((np.arange(len(docs)), -docs))[:VOCABULARY]
    vocabulary = {names[i]: k + 1 for k, i in enumerate(np.union1d(common, np.flatnonzero(telling)))}
    known = np.array([vocabulary.get(w, 0) for w in number], dtype=np.int32)
    model = ToxicityModel(vocabulary, np.zeros((3, len(vocabulary) + 1)), np.array([[1.0, 1.0], [1.0, 1.0]]), flat_curve)
    chosen = [(w, t) for w, t, f in zip(words, y, fit, strict=True) if f and len(w)]
    if not chosen:
        return model
    sizes = np.array([len(w) for w, _ in chosen])
    ids = known[np.concatenate([w for w, _ in chosen])]
    label = np.concatenate([telling[w] * float(t) for w, t in chosen])
    del words, number
    first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    before[first], after[last] = 0, 0
    came = np.roll(label, 1)
    came[first] = 0
    seen = np.array([[((came == i) & (label == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    size = model.weights.shape[1]
    theta, g2 = np.zeros(3 * size + 4), np.zeros(3 * size + 4)
    theta[-3] = -3.0  # a toxic word after an ordinary one is rare
    for _ in range(rounds):
        weights, logmoves = theta[:-4].reshape(3, size), theta[-4:].reshape(2, 2)
        e = weights[0][ids] + weights[1][before] + weights[2][after]
        p, expect, _ = marginals(e, sizes, np.exp(logmoves), expected=True)
        miss = label - p
        grad = np.concatenate([np.bincount(i, miss, minlength=size) for i in (ids, before, after)] + [(seen - expect).ravel()])
        grad -= 0.005 * np.concatenate([theta[:size], 4 * theta[size:-4], 0.1 * theta[-4:]])
        g2 += grad ** 2
        theta += 1.0 * grad / (np.sqrt(g2) + 1e-6)
    model.weights, model.moves = theta[:-4].reshape(3, size), np.exp(theta[-4:].reshape(2, 2))

    kept = np.flatnonzero(~fit) if (~fit).sum() >= 20 and len(set(y[~fit])) == 2 else np.arange(len(y))
    x = evidence(*model.tag([texts[i] for i in kept]))
    t = y[kept].astype(float)
    w = np.where(t > 0, shares[1] / max(1, t.sum()), shares[0] / max(1, (1 - t).sum()))
    w *= len(t) / w.sum()
    curve = flat_curve.copy()
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-x @ curve))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 0.02 * np.eye(3)
        curve += np.clip(np.linalg.solve(h, x.T @ (w * (t - q)) - 0.02 * curve), -2, 2)
    model.curve = curve
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[pd.DataFrame, tuple[float, float]]:
    """``rows`` rows (text, toxic), half of each label, 64 MB at most, and the rows of each label in ``labels``."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of("doc_id", 5) != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = (float(counts.get(0, 0)), float(counts.get(1, 0)))
    # Of each label the smallest hashes: at most a few more than asked for are joined, so their broadcast is bounded.
    near = F.when(F.col("toxic") == 1, F.lit(hash_limit(rows / 2, shares[1]))).otherwise(F.lit(hash_limit(rows / 2, shares[0])))
    picked = known.where(F.xxhash64("doc_id", F.lit(3)) <= near)
    both = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(picked), "doc_id")
    got = hash_sample(both, {t: n for t, n in counts.items() if n}, rows / 2, group="toxic").toPandas()
    got["toxic"] = got["group"].astype(int)
    return got.sort_values(["hash", "text"]).drop_duplicates("text").reset_index(drop=True), shares


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 3000) -> ToxicityModel:
    sample, shares = labelled_sample(docs, labels, train_rows)
    return train(list(sample["text"]), list(sample["toxic"]), shares)


def toxic_spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of neighbouring toxic words: code point offsets (end exclusive) and the largest marginal."""
    out: list[dict] = []
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] >= least:
            if out and out[-1]["word"] == k - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[k])), "word": k}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[k]), "word": k})
    return [{k: s[k] for k in ("start", "end", "p")} for s in out]


def score_texts(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted, toxic_words (expected number), spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, most=4_000_000):
                texts = strings(part)
                p, sizes = shared.value.tag(texts)
                score = shared.value.scores(p, sizes)
                ends = np.cumsum(sizes)
                own = [p[e - s:e] for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    column(part, "doc_id"), column(part, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                    pa.array([float(x.sum()) for x in own]),
                    pa.array([toxic_spans(t, x) if len(x) and x.max() >= 0.5 else [] for t, x in zip(texts, own, strict=True)], span)],
                    names=["doc_id", "held_out", "score", "predicted", "toxic_words", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(arrow, run, "doc_id long, held_out boolean, score double, predicted int, toxic_words double, "
                                "spans array<struct<start: int, end: int, p: double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; columns as they were."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts, out, i = [t or "" for t in text], [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 4_000_000):
                size += len(texts[j])
                j += 1
            out.append(shared.value.scores(*shared.value.tag(texts[i:j])))
            i = j
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < least)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending offsets of every text by a linear-chain conditional random field."""
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs, learn(docs, read_table(spark, sf_dir, "labels")))
