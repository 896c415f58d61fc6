"""Fill-in-the-middle and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import pytest

from tests.llm.helpers import LONG, ODD, clashing, empty, odd
from weekcraft.llm import audit, infill

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_infill(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing strings."""
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


# --- fill in the middle --------------------------------------------------------------------

def test_transform_and_restore_random_texts():
    rng = random.Random(3)
    letters = "abcXYZ <>PSM\né中\U0001F600.0"
    forms = set()
    for i in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        form, n, p, m, out = infill.transform(text, i)
        assert (n, form, p, m, out.decode()) == plain_infill(i, text)
        assert infill.restore(out, form) == text
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("text", ["x", "<P", "P>", "<", "<P<", "a<S", "M>b", "<P>", "no <M> form", "é", LONG])
def test_borders_and_sentinels(text):
    for i in range(40):
        form, n, p, m, out = infill.transform(text, i)
        assert (n, form, p, m, out.decode()) == plain_infill(i, text)
        assert infill.restore(out, form) == text


def test_reversal_over_several_blocks():
    import numpy as np
    for n in (0, 1, 2, infill.BLOCK, 2 * infill.BLOCK, 2 * infill.BLOCK + 1, 5 * infill.BLOCK + 7):
        data = bytearray(np.random.default_rng(n).integers(0, 256, n + 10, dtype=np.uint8).tobytes())
        want = data[:5] + data[5:5 + n][::-1] + data[5 + n:]
        infill.reverse(np.frombuffer(data, dtype=np.uint8), 5, 5 + n)
        assert data == want
    data = bytearray(b"0123456789")
    infill.exchange(data, 2, 5, 9)
    assert data == b"0156782349"


def test_infill_of_odd_rows(spark):
    for docs in (odd(spark), clashing(spark)):
        rows = infill.restored_texts(infill.fill_in_middle(docs)).collect()
        got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["restored"]) for r in rows)
        want = []
        for doc_id, text, *_ in ODD:
            n, form, p, m, out = plain_infill(doc_id, text)
            want.append((str(doc_id), n, form, str(p), str(m), out, text or ""))
        assert got == sorted(want)
    assert infill.restored_texts(infill.fill_in_middle(empty(spark))).count() == 0


def test_infill_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = infill.op11_infill(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, out = plain_infill(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == sha(out) and r["restored_sha256"] == sha(docs[r["doc_id"]] or "")


# --- filter audit --------------------------------------------------------------------------

def plain_audit(docs, labels):
    """{(part, order, step): values} by applying every order to every document."""
    marks = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            q, t = marks.get(doc_id, (0, 0))
            marks[doc_id] = (q or int(quality == 1), t or int(toxic == 1))
    rows = []
    for doc_id, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        rank = (doc_id is None, doc_id or 0)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": any((o is None, o or 0) < rank and (u or "") == t for o, u, _ in docs)}
        rows.append((part or "", {f for f, x in fails.items() if x}, *marks.get(doc_id, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own),
                                                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


def test_swaps_reach_every_order_and_keep_the_counts():
    rng = random.Random(8)
    masks = {m: (rng.randint(1, 9), rng.randint(0, 3), rng.randint(0, 3)) for m in rng.sample(range(32), 20)}
    diagram = audit.Diagram(masks)
    seen = {diagram.order}
    for level in audit.exchanges(5):
        diagram.swap(level)
        seen.add(diagram.order)
        assert diagram.path() == audit.Diagram(masks, diagram.order).path()
        assert diagram.root[2] == tuple(map(sum, zip(*masks.values(), strict=True)))
    assert len(seen) == 120


def test_word_numbers_of_long_texts(monkeypatch):
    data = LONG.encode() + b"\x0b tail tail\x0c"
    want = audit.word_numbers(data)
    monkeypatch.setattr(audit, "BLOCK", 1000)
    assert audit.word_numbers(data) == want


def test_audit_against_every_order_of_every_document(spark):
    rng = random.Random(2)
    texts = ["", None, "word " * 250, "a b c " * 80, "Big Words HERE now", "x # y", " ".join(f"w{i}" for i in range(230)), " ".join(f"W{i}" for i in range(230)) + " |"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(160)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = audited(audit.audit_filters(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain_audit(docs, labels)


def test_audit_of_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    want = plain_audit([(i, t, lang) for i, t, lang, *_ in ODD], [(1, 1, 0), (1, 0, 1), (8, 1, None)])
    assert audited(audit.audit_filters(odd(spark), labels)) == want
    assert audited(audit.audit_filters(clashing(spark), labels)) == want
    assert audit.audit_filters(empty(spark), labels).count() == 0
    assert audit.audit_filters(odd(spark), labels.limit(0)).count() == 600 * len({p for p, _, _ in want})
