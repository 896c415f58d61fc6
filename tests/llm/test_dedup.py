"""Exact dedup and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import clashing, empty, odd, rows
from weekcraft.llm import exact, jaccard
from weekcraft.llm.common import build_filter, filter_bits, in_filter
from weekcraft.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_groups(data):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(data):
        h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups[h].append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for h, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), h) for m in members]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_groups_of_odd_rows(spark):
    data = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    got = exact.exact_groups(odd(spark))
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute_groups(data)
    kept = [r for r in got.collect() if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len({h for *_, h in brute_groups(data)})


def test_exact_stage_keeps_columns_and_one_row_a_group(spark):
    docs = clashing(spark)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in out.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()})


def test_exact_of_empty_table(spark):
    assert exact.exact_groups(empty(spark)).count() == 0 and exact.drop_copies(empty(spark)).count() == 0


def test_exact_with_a_full_filter(spark):
    """A filter that lets everything through costs time only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(exact.exact_groups(docs, most_bits=1)) == rows(exact.exact_groups(docs))


def test_filter_has_no_false_negatives(spark):
    keys = [(k,) for k in [1, 2, 2, 3, 3, 3, -5, -5, 9]] + [(None,)]
    packed = build_filter(spark.createDataFrame(keys, "key long"), filter_bits(9), least=2)
    assert in_filter(packed, np.array([2, 3, -5], dtype=np.int64).view(np.uint64)).all()
    assert not in_filter(packed, np.array([1, 9, 77], dtype=np.int64).view(np.uint64)).any()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, 300 + i) for i in range(1, 50)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    want = {x: top(x) for x in {n for e in edges if e[0] != e[1] for n in e}}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def word_shingles(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts, least=0.8):
    """(linked other sets, group label) per document."""
    sets = [word_shingles(t) for t in texts]
    distinct = sorted(set(s for s in sets if s), key=str)
    links = {s: [o for o in distinct if o != s and len(s & o) >= least * len(s | o)] for s in distinct}
    group = {}
    for s in distinct:
        if s in group:
            continue
        todo, group[s] = [s], s
        while todo:
            for o in links[todo.pop()]:
                if o not in group:
                    group[o] = s
                    todo.append(o)
    return sets, links, group


def check_near(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard.near_groups(docs).collect()}
    sets, links, group = brute_links([t for _, t in data])
    for (doc, _), s in zip(data, sets, strict=True):
        mates = [d for (d, _), o in zip(data, sets, strict=True) if s and o and group[o] == group[s]] or [doc]
        assert got[doc]["class_id"] == min(mates)
        assert got[doc]["n_links"] == (len(links[s]) if s else 0)
        assert got[doc]["stays"] == (doc == min(mates))


def near_copies(seed, base_words=80, copies=40):
    rng = random.Random(seed)
    data, n = [], 0
    for family in range(6):
        words = [f"w{family}_{rng.randint(0, 500)}" for _ in range(base_words)]
        for _ in range(copies // (family + 1)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10_000)}"
            data.append((n, " ".join(w)))
            n += 1
    data += [(n + i, f"single text number {i} with words {i * 7} of its own {i * 13}") for i in range(30)]
    return data + [(n + 100, None), (n + 101, ""), (n + 102, "two words"), (n + 103, "Two  words")]


def test_join_equals_brute_force(spark):
    check_near(spark, near_copies(3))


def test_join_in_chunks(spark, monkeypatch):
    """A component cut into many chunks counts every pair once."""
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 7)
    check_near(spark, near_copies(4))


def test_join_on_given_documents(spark):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_near(spark, data)


def test_join_of_odd_rows(spark):
    docs = clashing(spark)
    assert jaccard.near_groups(docs).count() == docs.count()
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} >= {1, 3, 4, 5, 6, 7, 8}
    assert jaccard.near_groups(empty(spark)).count() == 0 and jaccard.keep_one(empty(spark)).count() == 0


def test_overlaps_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (jaccard.overlaps(sets) == want).all()


def test_signature_estimates_likeness():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    errors = []
    for share in (0.5, 0.8, 0.9):
        n = int(1000 * share)
        other = np.concatenate([base[:n], rng.integers(0, 1 << 63, 1000 - n).astype(np.uint64)])
        j = n / (2000 - n)
        errors.append(abs((jaccard.signature(base) == jaccard.signature(other)).mean() - j))
    assert max(errors) < 0.12


def test_pairs_at_the_threshold_beside_many_copies(spark):
    """Close copies around them do not cost the pairs of likeness 0.8 their links."""
    rng = random.Random(9)

    def text(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    data = []
    for i in range(4300):
        base = text(44)  # 40 shingles; ten more words make a likeness of 0.8, one more 0.976
        data += [(2 * i, base), (2 * i + 1, f"{base} {text(10 if i < 300 else 1)}")]
    got = jaccard.near_groups(spark.createDataFrame(data, "doc_id long, text string"))
    linked = {r["doc_id"]: r["class_id"] for r in got.collect()}
    assert [i for i in range(4300) if linked[2 * i + 1] != 2 * i] == []


def test_depth_reaches_the_recall_at_the_threshold():
    assert jaccard.depth_for(0.8, 0.999) == 5
    for least in (0.4, 0.6, 0.8, 0.9, 0.95):
        d = jaccard.depth_for(least, 0.999)
        assert 1 - (1 - least ** d) ** jaccard.TREES >= 0.999
