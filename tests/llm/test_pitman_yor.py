"""The Pitman-Yor model against enumeration, naive counts and held-out texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, clashing, empty, odd
from weekcraft.llm import pitman_yor as py

SF = "/root/testdata/sf0.001"


def naive_words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def partitions(n):
    if not n:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1:]]
        yield [*p, 1]


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.9])
def test_stirling_numbers_sum_over_all_seatings(discount):
    logs = py.stirling_logs(discount, 7)
    for c in range(1, 8):
        want = Counter()
        for p in partitions(c):
            want[len(p)] += math.prod(k - discount for size in p for k in range(1, size))
        for t in range(1, c + 1):
            assert math.isclose(math.exp(logs[c, t]), want[t], rel_tol=1e-9)


def test_draws_follow_the_exact_conditional():
    d, strength, base, others, c, n = 0.6, 1.3, 0.2, 7, 5, 60_000
    weights = Counter()
    for p in partitions(c):
        seat = math.prod(k - d for size in p for k in range(1, size))
        weights[len(p)] += seat * math.prod((strength + d * (others + s)) * base for s in range(len(p)))
    total = sum(weights.values())
    got = Counter(py.draw_tables(np.full(n, c), np.full(n, base), np.full(n, others), strength, d, py.stirling_logs(d), (1, 2, np.arange(n))).tolist())
    for t in range(1, c + 1):
        p = weights[t] / total
        assert abs(got[t] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_large_parties_open_as_many_tables_as_one_by_one():
    d, strength, base, others, c, n = 0.5, 1.0, 0.05, 40, 3000, 300
    rng = np.random.default_rng(0)
    tables = py.draw_tables(np.full(n, py.PARTY), np.full(n, base), np.full(n, others), strength, d, py.stirling_logs(d), (5, np.arange(n)))
    for i in range(py.PARTY, c):
        new = (strength + d * (others + tables)) * base
        tables = tables + (rng.random(n) < new / (new + i - d * tables))
    got = py.draw_tables(np.full(n, c), np.full(n, base), np.full(n, others), strength, d, py.stirling_logs(d), (5, np.arange(n)))
    assert abs(got.mean() / tables.mean() - 1) < 0.03


def test_hashes_tell_words_apart_and_fold_capitals():
    words = {"".join(random.Random(i).choices("abcdefé0.", k=i % 9 + 1)) for i in range(3000)}
    texts = sorted(words)
    hashes, starts = py.word_hashes((" ".join(texts) + "\n").encode())
    assert len(set(hashes.tolist())) == len(texts) and hashes.min() > 0 and hashes.max() < 2 ** 55
    assert py.word_hashes("\t THE\x0bthe\r\nThÉ thÉ  ".encode())[0].tolist()[0] == py.word_hashes(b"the")[0][0]
    assert len(py.word_hashes(b"")[0]) == len(py.word_hashes(b" \n\t")[0]) == 0
    giant = b"x" * 200_000
    assert py.word_hashes(giant + b"y")[0][0] != py.word_hashes(giant + b"z")[0][0]
    assert py.word_hashes(b"a " + giant + b" b")[0].tolist() == [py.word_hashes(w)[0][0] for w in (b"a", giant, b"b")]


def test_pieces_change_no_token(monkeypatch):
    texts = ["one two three", "", LONG, " \n ", "x", "the end " * 4000]

    def tokens():
        return [tuple(np.concatenate(x).tolist()) for x in zip(*py.token_runs(texts), strict=True)]

    want = tokens()
    assert len(want[0]) == sum(len(t.split()) + 1 for t in texts)
    monkeypatch.setattr(py, "SEGMENT", 1000)
    assert tokens() == want


def naive_base(learned, text):
    counts = Counter(w for t in learned for w in [*naive_words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    tokens = [*naive_words(text), None]
    return len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)


@pytest.mark.parametrize("most_common", [1 << 17, 20, 0])
def test_base_and_scores_do_not_depend_on_where_words_are_looked_up(spark, most_common):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).cache()
    model = py.learn(docs.where("doc_id % 3 > 0"), burn=1, samples=2)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    learned = [t for i, t in texts.items() if i % 3]
    want = {r["doc_id"]: r["score"] for r in py.score_texts(docs, model).collect()}
    for r in py.score_texts(docs, model, most_common=most_common).collect():
        n, known, total, base = naive_base(learned, texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-5)
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / n), rel_tol=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("a b c d e the the of".split(), k=30))) for i in range(40)], "doc_id long, text string")
    model = py.learn(docs, burn=1, samples=3)
    rows = model.rows.collect()
    escapes, unknown = model.escapes(), model.unknown_root()
    p = unknown @ escapes / len(escapes)
    for r in rows:
        p = p + np.array(r["root"]) @ escapes / len(escapes)
        for k, x in zip(r["contexts"], r["own"], strict=True):
            p[k] += x
    assert np.allclose(p, 1)
    rest = model.restaurants
    assert rest.tokens == 40 * 31 and rest.words == len(rows)
    assert all((t <= rest.customers).all() and (t[rest.customers > 0] > 0).all() for t in rest.tables)


def test_every_word_has_a_restaurant_of_its_own(spark):
    docs = spark.createDataFrame([(i, f"before{i % 200} after{i % 200}") for i in range(2000)], "doc_id long, text string")
    for most in (1 << 17, 300, 0):
        model = py.learn(docs, burn=1, samples=2, most_common=most)
        assert {len(r["contexts"]) for r in model.rows.collect()} == {1, 200}  # END follows 200 words
        sure = docs.where("doc_id < 200")
        other = sure.selectExpr("doc_id", "concat('before', doc_id, ' after', (doc_id + 1) % 200) AS text")
        # One of 200 words at the start, then what always follows.
        assert all(r["score"] > math.log10(0.5 / 200) for r in py.score_texts(sure, model, most_common=most).collect())
        assert all(r["score"] < math.log10(0.01 / 200) for r in py.score_texts(other, model, most_common=most).collect())


def test_seating_does_not_depend_on_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).cache()
    a, b = (py.learn(docs.repartition(n), burn=1, samples=1) for n in (1, 7))
    assert [t.tolist() for t in a.restaurants.tables] == [t.tolist() for t in b.restaurants.tables]
    assert a.restaurants.root_tables == b.restaurants.root_tables
    assert {r["word"]: r for r in a.rows.collect()} == {r["word"]: r for r in b.rows.collect()}


def test_odd_rows_and_empty_tables(spark):
    for docs in (odd(spark), clashing(spark)):
        model = py.learn(docs.where("doc_id <> 7"), burn=1, samples=1)
        rows = py.score_texts(docs, model).collect()
        assert len(rows) == docs.count()
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
        assert [r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    nothing = py.learn(empty(spark))
    assert py.score_texts(empty(spark), nothing).count() == 0
    for r in py.score_texts(odd(spark), nothing).collect():
        assert (r["n_known"], r["train_tokens"]) == (0, 0) and abs(r["score"]) < 1e-9 and abs(r["base_score"]) < 1e-9


def test_query_predicts_held_out_texts_better_than_the_base(spark):
    rows = py.op12_pitman_yor(spark, SF)
    got = {r["doc_id"]: r for r in rows.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    assert {i for i, r in got.items() if r["held_out"]} == held and set(got) == set(texts)
    n, known, total, base = naive_base([t for i, t in texts.items() if i not in held], texts[min(held)])
    r = got[min(held)]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    for p in py.perplexity(rows.where(F.col("doc_id").isNotNull()), "held_out").collect():
        assert p["perplexity"] < p["base_perplexity"]


def test_scoring_reads_texts_once_and_meets_the_model_in_rounds(spark, monkeypatch):
    """What is shuffled at once is a share of the tokens that are not looked up in place."""
    rng = random.Random(7)
    words = [f"w{int(60 ** rng.random())}" for _ in range(2400)]
    texts = [" ".join(words[40 * i:40 * i + 40]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = py.learn(docs.where("doc_id < 40"), burn=1, samples=1, most_common=8)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    met, with_rare = [], py.with_rare
    monkeypatch.setattr(py, "with_rare", lambda rows, *rest: met.append(rows.count()) or with_rare(rows, *rest))
    kept = model.codes.hashes
    runs = [(w, u) for w, u, _ in py.token_runs(texts)]
    far = sum(int((~(np.isin(w, kept) & np.isin(u, kept))).sum()) for w, u in runs)
    scores = {}
    for near_rounds, far_rounds in ((2, 4), (1, 1)):
        monkeypatch.setattr(py, "NEAR_ROUNDS", near_rounds, raising=False)
        monkeypatch.setattr(py, "FAR_ROUNDS", far_rounds, raising=False)
        before, met[:] = read.value, []
        rows = py.score_texts(docs.mapInArrow(counted, docs.schema), model, most_pairs=20)
        assert read.value - before == len(texts)
        scores[far_rounds] = {r["doc_id"]: r["score"] for r in rows.collect()}
        assert sum(met) == far and len(met) == 2 * far_rounds
    assert scores[1].keys() == scores[4].keys() == set(range(60))
    assert all(math.isclose(s, scores[4][i], rel_tol=1e-6) for i, s in scores[1].items())


@pytest.mark.parametrize("most_common", [1 << 17, 30, 0])
def test_pairs_are_counted_in_blocks(spark, monkeypatch, most_common):
    """A row that is shuffled or staged holds many pairs; counts are those of every pair, in whichever bucket."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(300 ** rng.random())}" for _ in range(200)) for _ in range(80)] + [None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter()
    for t in texts:
        words = [0, *(int(py.word_hashes(w.encode())[0][0]) for w in naive_words(t)), 0]
        want.update(zip(words[1:], words[:-1], strict=True))
    monkeypatch.setattr(py, "BLOCK", 4000)
    codes = py.common_words(docs, most=most_common)
    assert codes.tokens == sum(want.values())
    rows = py.pair_counts(docs, codes).collect()
    names = {int(r): int(h) for r, h in zip(codes.ranks, codes.hashes, strict=True)}
    got = Counter()
    for r in rows:
        word, context, n = py.unpack(r["block"], 3)
        assert (r["ones"], r["twos"]) == ((n == 1).sum(), (n == 2).sum())
        assert (((word < len(codes)) & (context < len(codes))) == r["coded"]).all()
        for w, u, k in zip(word.tolist(), context.tolist(), n.tolist(), strict=True):
            pair = tuple(names[x] if x in names else x - py.FIRST for x in (w, u))
            assert pair not in got
            got[pair] = k
    assert got == want
    assert len(rows) <= 2 * py.buckets_for(codes.tokens) < len(want) / 100


def test_parties_with_one_coded_word_are_seated_in_blocks(spark):
    """Only parties of two words without a code are a row each; every pair that occurs twice or more is in one party."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(300 ** rng.random())}" for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = py.learn(docs, burn=1, samples=1, most_common=30)
    common = len(model.codes)
    names = {int(r): int(h) for r, h in zip(model.codes.ranks, model.codes.hashes, strict=True)}
    want = Counter((w, u) for words, before, _ in py.token_runs(texts) for w, u in zip(words.tolist(), before.tolist(), strict=True))
    got, kinds = Counter(), Counter()
    for r in model.parties.collect():
        held = np.array([[r[c]] for c in py.PARTY_COLUMNS]) if r["block"] is None else py.unpack(r["block"], len(py.PARTY_COLUMNS))
        kind = py.kind_of(held[0], held[1], common)
        assert (kind == (py.BARE if r["block"] is None else py.NEAR if r["bucket"] is None else py.MIXED)).all()
        assert ((held[3] >= 1) & (held[3] <= held[2])).all()
        kinds.update(kind.tolist())
        for w, u, n in held[:3].T.tolist():
            got[tuple(names[x] if x in names else x - py.FIRST for x in (w, u))] += n
    assert got == {pair: n for pair, n in want.items() if n > 1}
    assert min(kinds[k] for k in (py.NEAR, py.MIXED, py.BARE)) > 50


def test_packed_numbers_and_places_come_back():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 62, 1000), rng.normal(size=1000)
    x, y = py.unpack(py.pack(a, b), 2)
    assert (x == a).all() and (y.view(np.float64) == b).all()
    for n in (0, 1, 5000):
        keys = np.unique(rng.integers(0, 2 ** 55, n))
        index = py.Index(keys)
        assert (index.find(keys) == np.arange(len(keys))).all()
        assert (index.find(np.setdiff1d(rng.integers(0, 2 ** 55, 100), keys)) == -1).all()
