"""Toxicity, language, mixing, revisits, the pipeline and the registered queries."""

from __future__ import annotations

import itertools
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, clashing, empty, odd, rows
from weekcraft.llm import common, language, mixing, toxicity, warc

SF = "/root/testdata/sf0.01"


# --- toxicity ------------------------------------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.random((2, 2)) + 0.1
    sizes = np.array([3, 0, 1, 7])
    e = rng.normal(size=sizes.sum())
    got, seen, logz = toxicity.marginals(e, sizes, moves, expected=True)
    want, counts, logs, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        own, weights = e[at:at + n], []
        for path in itertools.product((0, 1), repeat=n):
            w, last = 1.0, 0
            for s, x in zip(path, own, strict=True):
                w *= moves[last, s] * np.exp(s * x)
                last = s
            weights.append((w, path))
        z = sum(w for w, _ in weights)
        logs += np.log(z)
        want += [sum(w for w, p in weights if p[t]) / z for t in range(n)]
        for w, p in weights:
            for a, b in zip((0, *p), p):
                counts[a, b] += w / z
        at += n
    assert np.allclose(got, want) and np.allclose(seen, counts) and np.isclose(logz, logs)


def test_marginals_over_many_chunks():
    """Long sequences agree with a word-by-word recursion."""
    rng = np.random.default_rng(2)
    moves = np.array([[1.5, 0.2], [0.7, 0.9]])
    sizes = np.array([toxicity.CHUNK * 3 + 5, 1, toxicity.CHUNK, 400])
    e = rng.normal(size=sizes.sum()) * 3
    got = toxicity.marginals(e, sizes, moves)
    at = 0
    for n in sizes:
        f = np.exp(e[at:at + n])
        a, fwd = np.array([1.0, 0.0]), []
        for t in range(n):
            a = (a @ moves) * [1, f[t]]
            a /= a.sum()
            fwd.append(a)
        b, want = np.ones(2), np.zeros(n)
        for t in range(n - 1, -1, -1):
            want[t] = fwd[t][1] * b[1] / (fwd[t] @ b)
            b = moves @ (b * [1, f[t]])
            b /= b.sum()
        assert np.allclose(got[at:at + n], want)
        at += n


def test_toxicity_on_rows_kept_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    apart = [i for i in toxic if i in got and got[i]["held_out"]]
    right = sum(got[i]["predicted"] == toxic[i] for i in apart) / len(apart)
    assert right > 0.97
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = [(texts[i][s["start"]:s["end"]]) for i, r in got.items() for s in r["spans"]]
    assert spans and all(s.strip() == s and s for s in spans)


def test_toxicity_of_odd_rows(spark):
    model = toxicity.train(["you idiot", "fine day"] * 30 + ["you moron idiot ok", "a nice fine day"] * 10, [1, 0] * 40, (80.0, 20.0))
    docs = clashing(spark)
    assert toxicity.score_texts(docs, model).count() == len(ODD)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.drop_toxic(docs, model).count() == len(ODD)
    assert toxicity.score_texts(empty(spark), model).count() == 0
    none = toxicity.learn(odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["predicted"] for r in toxicity.score_texts(odd(spark), none).collect()} == {0}
    some = toxicity.learn(odd(spark), spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score_texts(odd(spark), some).collect())


# --- language ------------------------------------------------------------------------------

def test_language_on_rows_kept_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.identify(docs, train_rows=800).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    apart = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in apart) / len(apart) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(clashing(spark)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got
    assert language.identify(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(nothing).collect()] == [("und", 0.0, True)]


def test_language_scores_do_not_depend_on_the_batch():
    model = language.train(["the cat sat on the mat"] * 20 + ["der hund ist im haus"] * 20, ["en"] * 20 + ["de"] * 20)
    texts = ["the dog", "", "x", "der kater", "12 34", "das haus ist"]
    together, some = model.scores(texts)
    for t, p, s in zip(texts, together, some, strict=True):
        alone, own = model.scores([t])
        assert np.allclose(alone[0], p, atol=1e-6) and own[0] == s


# --- mixing --------------------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 900, "c": 50, None: 300}, {"x": 0, "y": 0}, {"s1": 100}, {"b": 3, "B": 70, "é": 20, "z": 500, "a": 0}):
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, m long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 500):
        p, size = rng.random(n), rng.integers(0, 60, n).astype(float)
        out = mixing.flight(p, size, np.random.default_rng(n))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-4


def test_flight_keeps_probabilities_on_average():
    p, size = np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.6]), np.array([3.0, 9.0, 4.0, 4.0, 7.0, 1.0])
    mean = np.mean([mixing.flight(p, size, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.05


@pytest.mark.parametrize("bucket,fan", [(4096, 1024), (16, 4)])
def test_mix_meets_targets(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN", fan)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    units = mixing.mix_units(docs)
    got = rows(units, "doc_id", "copies")
    per = {}
    for r in units.collect():
        assert r["copies"] in (0, 1, 2)
        t = per.setdefault(r["source"], [r["target"], 0])
        t[1] += r["copies"] * r["size"] * r["m"]
    # The last bucket of tiny levels has few units to turn over: there one document may be missed.
    most = docs.selectExpr("max(size(split(trim(text), '\\\\s+')))").first()[0] if bucket < 100 else 5
    assert all(abs(taken - target) <= max(most, 0.002 * target) for target, taken in per.values())
    assert rows(mixing.mix_units(docs.repartition(7)), "doc_id", "copies") == got
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(c for _, c in got)


def test_mix_of_odd_rows(spark):
    docs = clashing(spark)
    units = mixing.mix_units(docs)
    assert sum(r["m"] for r in units.collect()) == len(ODD)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_units(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# --- revisits ------------------------------------------------------------------------------

def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top": "example.com/a/b?a=1&b=2", "https://example.com/a/b?b=2&a=1&ref=z": "example.com/a/b?a=1&b=2",
            "example.com": "example.com", "": "", "http://x.org/?": "x.org"}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.canonical_url(warc.F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in got} == urls


RECORDS = "record_id long, url string, kind string, time long, etag string, last_modified string, headers map<string,string>"


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_revisits_equal_brute_force(spark, slices):
    rng = np.random.default_rng(6)
    recs = []
    for i in range(400):
        kind = "response" if rng.random() < 0.4 else "revisit"
        url = "http://hot.example/" if rng.random() < 0.5 else f"http://h{rng.integers(0, 9)}.example/{rng.integers(0, 4)}"
        tag = (None, '"a"', 'W/"a"', '"b"')[int(rng.integers(0, 4))]
        recs.append((i, None if rng.random() < 0.03 else url, kind, None if rng.random() < 0.03 else int(rng.integers(0, 120)), tag,
                     (None, "d1", "d2")[int(rng.integers(0, 3))], {"date": str(i), "content-length": str(i), ("x" if kind == "response" else "y"): "1"}))
    got = {r["revisit_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(recs, RECORDS), slices).collect()}
    bare = lambda t: t.removeprefix("W/")
    for i, url, kind, time, tag, day, headers in recs:
        if kind != "revisit":
            continue
        earlier = [r for r in recs if r[2] == "response" and url and r[1] == url and time is not None and r[3] is not None and r[3] < time]
        r = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        status = ("missing" if r is None else ("unchecked" if r[4] is None else "resolved" if bare(r[4]) == bare(tag) else "stale") if tag
                  else ("unchecked" if r[5] is None else "resolved" if r[5] == day else "stale") if day else "unchecked")
        assert (got[i]["response_id"], got[i]["status"]) == (r and r[0], status)
        if status == "resolved":
            assert got[i]["headers"] == {"date": str(i), "content-length": str(r[0]), "x": "1", "y": "1"}
    assert len(got) == sum(r[2] == "revisit" for r in recs)


def test_revisits_of_empty_table(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


# --- registration --------------------------------------------------------------------------

def test_queries_are_registered():
    import __spark_entry__
    import corpus_pipeline
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
    assert {"op2_exact_dedup", "op3_warc_revisits"} <= __spark_entry__.oracle_sql().keys()


def test_pipeline_stages(spark):
    import corpus_pipeline
    from weekcraft.session import materialize
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), f"test_{name}")
        assert out.columns == columns
        if name != "mixing":
            assert 0.7 * docs.count() < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0
    assert count


def test_pipeline_survivors_by_brute_force(spark):
    """run() end to end: which documents survive each filter by plain Python, and what becomes of them."""
    import re

    import corpus_pipeline
    from sentencepiece import SentencePieceProcessor
    from tests.llm.test_dedup import brute_links
    from weekcraft.llm.viterbi import MODEL
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    given = {r["doc_id"]: r for r in docs.collect()}
    clean = {i: r["text"] or "" for i, r in given.items() if toxicity_of(model, r["text"] or "") < 0.5}
    groups = {}
    for i, t in clean.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    unique = sorted(min(ids, key=lambda i: (-len(clean[i]), i)) for ids in groups.values())
    sets, _, group = brute_links([clean[i] for i in unique])
    mates = {}
    for i, s in zip(unique, sets, strict=True):
        mates.setdefault(group[s] if s else i, []).append(i)
    survivors = {min(ids) for ids in mates.values()}
    assert len(survivors) < len(unique) < len(clean) < len(given)
    rows = corpus_pipeline.run(spark, small).collect()
    times = Counter(r["doc_id"] for r in rows)
    assert set(times) <= survivors and max(times.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", clean[i])) for i in survivors}
    sources = {given[i]["source"] for i in survivors}
    total = {s: sum(size[i] for i in survivors if given[i]["source"] == s) for s in sources}
    taken = {s: sum(size[i] * n for i, n in times.items() if given[i]["source"] == s) for s in sources}
    target = brute_targets(total)
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in sources)
    sp = SentencePieceProcessor(model_file=common.tokenizer_path(MODEL))
    assert all(r["ids"] == sp.encode(clean[r["doc_id"]]) for r in rows)


def toxicity_of(model, text):
    return float(model.scores(*model.tag([text]))[0])


def brute_targets(total):
    """150 % of all words by weights 5, 2, 1 in the order of the sources, none above twice its source, the excess shared again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(total), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    return target


# --- samples, letters ----------------------------------------------------------------------

@pytest.mark.parametrize("total", [10, 5_000, 10 ** 7, 10 ** 10, 10 ** 13])
def test_a_sample_of_a_table_of_any_size_is_not_empty(total):
    """The share of the hash range under the limit holds the rows asked for, with a margin, however many rows there are."""
    limit = common.hash_limit(1500, total)
    expected = (limit + 2 ** 63) / 2 ** 64 * total
    if total <= 1500:
        assert limit == 2 ** 63 - 1
    else:
        assert 1500 <= expected * (1 + 1e-9) and expected < 1500 + 6 * 1500 ** 0.5 + 18


def test_samples_hold_the_smallest_hashes_within_rows_and_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 50), "ab"[i % 2]) for i in range(2000)] + [(7, "twice", "a"), (3000, "y" * 40_000, "a")],
                                 "doc_id long, text string, lang string")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = common.hash_sample(rows, counts, 100, group="lang").collect()
    assert Counter(r["group"] for r in got) == {"a": 100, "b": 100}
    every = {g: sorted(r[0] for r in rows.where(F.col("lang") == g).select(F.xxhash64("doc_id", F.lit(3))).distinct().collect()) for g in "ab"}
    assert all(sorted(r["hash"] for r in got if r["group"] == g) == every[g][:100] for g in "ab")
    small = common.hash_sample(rows, counts, 100, group="lang", most_bytes=2000).collect()
    assert 0 < len(small) < 200 and all(sum(len(r["text"]) for r in small if r["group"] == g) <= 1000 for g in "ab")
    assert common.hash_sample(rows.limit(0), {}, 100, group="lang").count() == 0
    # A share as of ten thousand million rows leaves few of these, without failing.
    assert common.hash_sample(rows, {"a": 10 ** 10, "b": 10 ** 10}, 100, group="lang").count() <= 2


def test_texts_without_a_letter_are_undetermined(spark):
    texts = ["٣٤٥", "²³", "½ ¾", "Ⅷ", "123 456", "", None, "%&", "０１２"]
    docs = spark.createDataFrame([(i, f"the {w} of the house and", "en") for i, w in enumerate("abcdefgh" * 4)]
                                 + [(100 + i, f"der {w} von dem haus und", "de") for i, w in enumerate("abcdefgh" * 4)]
                                 + [(1000 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in language.identify(docs).where("doc_id >= 1000").collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_language_scores_by_brute_force(spark):
    """The whole prediction anew: letters by their Unicode category, n-grams one by one, mean, softmax."""
    import unicodedata
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language.training_sample(docs, 200)
    model = language.train(list(sample["text"]), list(sample["lang"]))

    def plain(text):
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        symbols = [0, *(ord(c) if unicodedata.category(o)[0] == "L" else 0 for c, o in zip(low, text, strict=True)), 0]
        total, n = np.zeros(len(model.langs)), 0
        for order in language.ORDERS:
            for i in range(len(symbols) - order + 1):
                if order > 2 and not symbols[i]:
                    continue
                total += model.table[language.subwords(np.array(symbols[i:i + order], dtype=np.uint32), order)[0]]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    texts = [r["text"] for r in docs.where("length(text) between 1 and 400").limit(40).collect()] + ["Ünïcode ﬀ İ ß 12", "a", "日本"]
    got, some = model.scores(texts)
    for t, p, ok in zip(texts, got, some, strict=True):
        assert ok == any(unicodedata.category(c)[0] == "L" for c in t)
        if ok:
            assert np.allclose(p, plain(t), atol=1e-5)


# --- revisits ------------------------------------------------------------------------------

RECORD = "record_id long, url string, kind string, time long, etag string, last_modified string, headers map<string,string>"


def test_headers_merge_whatever_their_case(spark):
    long = "v" * 100_000
    got = warc.resolve_revisits(spark.createDataFrame([
        (1, "http://a.org/x", "response", 10, '"t"', None, {"ETag": '"t"', "Date": "old", "Content-Length": "9", "Server": long, "X-Old": "1"}),
        (2, "http://A.org/x", "revisit", 20, 'W/"t"', None, {"etag": 'W/"t"', "date": "new", "content-length": "0", "x-new": long}),
        (3, "http://a.org/x", "revisit", 30, '"t"', None, None)], RECORD).withColumn("slice", F.lit("extra")).withColumn("carried", F.lit(1))).collect()
    assert {r["revisit_id"]: r["headers"] for r in got} == {
        2: {"etag": 'W/"t"', "date": "new", "Content-Length": "9", "Server": long, "X-Old": "1", "x-new": long},
        3: {"ETag": '"t"', "Date": "old", "Content-Length": "9", "Server": long, "X-Old": "1"}}


def test_default_ports_belong_to_their_scheme(spark):
    urls = ["http://a.org:80/", "https://a.org:443", "a.org:80", "http://a.org:443/", "https://A.org:80/", "HTTPS://www.a.org:443/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.canonical_url(F.col("url"))).collect()]
    assert got == ["a.org", "a.org", "a.org", "a.org:443", "a.org:80", "a.org"]
