"""Personal data by a semi-Markov conditional random field.

Base spans come from the fixed patterns of four kinds (email, ip, card, phone). The field adds spans
that the patterns miss, such as spelled-out addresses or numbers without a plus sign. It works on zones:
stretches of tokens around at-signs, spelled-out ones and clusters of digits. A segmentation of a zone
is a sequence of single outside tokens and of segments with a kind: any of up to ``LONGEST`` tokens, longer ones
that are numbers of up to 19 digits however they are separated, and spelled-out addresses of any length; a
segment's score comes from features of the whole span (digits, checksum, parts, separators, words
before it), so dynamic programming chooses boundaries and kinds together. Zones are
apart from each other, because outside of them every token is outside at no cost. A zone of any length is
searched whole: its segments are scored ``BLOCK`` tokens at a time, and only sums and best scores go on.

The field is learned by likelihood gradients in numpy on at most ``TRAIN_ZONES`` zones of a bounded sample
(``train_rows`` rows, those with the smallest hashes of the id, 64 MB at most; of a very long text all zones count towards
that bound): its base spans are the right segments, and ``REWRITINGS`` copies with rewritten spans (spelled-out at-signs
and dots, missing plus signs, other separators) teach the added ones. An added span is a segment of the best segmentation
that touches no base span and whose middle lies in a segment of its kind with a posterior of ``SURE`` or more, all segments
over it taken together. Base spans always stay.

Zones open at @, at bracketed "at" and "dot", at " dot ", at " at " before a dotted name, at four short numbers with dots, and at
runs of digits with blanks, dots, hyphens, slashes, underscores or brackets. Data without any of these are not
found; of a local part spelled with " dot " only the last label is; "look at example.com" reads like an address.

Null and empty texts have no spans; rows are read one by one, whole; an empty table gives an empty result.
Without any base span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, column, hash_sample, read_table, steps, strings

KINDS = ("email", "ip", "card", "phone")
LONGEST, SURE, TRAIN_ZONES, REWRITINGS = 20, 0.6, 1200, 3

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A number starts at the start of its digits: later starts give nothing where the first fails.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, ordered by start, then kind.

    Addresses are found from their at-signs: the longest run of local characters before it that no
    earlier address holds, which is where the leftmost match starts.
    """
    out: list[tuple[int, int, str]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        tail = DOMAIN.match(text, at + 1)
        if tail:
            start = at
            while start > free and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                free = tail.end()
                out.append((start, free, "email"))
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- zones ----------------------------------------------------------------------------------

TRIGGER = re.compile(r"@|[\[({<]\x20?(?:at|dot)\x20?[\])}>]|\x20dot\x20|\x20at\x20[A-Za-z0-9-]{1,63}\.[A-Za-z]"
                     r"|(?<![0-9])[0-9]{1,3}(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{1,3}){3}|[+(]?[0-9][0-9\x20()./_-]{6,}[0-9]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.DOTALL)
AT = re.compile(r"@|\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20")
DOT = re.compile(r"\.|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+")
WHOLE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + SPELLED.pattern.partition("+-]+")[2])
# What goes on behind or before a span: one more label of a domain, one more group of digits.
NEXT_LABEL = re.compile(r"(?:\.|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20)[A-Za-z0-9]")
NEXT_DIGITS, LAST_DIGITS = re.compile(r"[\x20./_-]{1,3}[0-9]"), re.compile(r"[0-9][\x20./_-]{1,3}$")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AROUND = 48
#: Characters of a training case, and tokens whose segments are scored together.
WIDEST, BLOCK = 2000, 1000
#: Tokens before a span's middle at which segments over it are looked for.
REACH = 60


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of ``AROUND`` characters and whole words about each trigger; those that touch are one, of any length."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    whole: list[tuple[int, int]] = []
    for k, (a, b) in enumerate(out):
        low, high = whole[-1][1] if whole else 0, out[k + 1][0] if k + 1 < len(out) else len(text)
        while a > low and text[a] in WORD and text[a - 1] in WORD:
            a -= 1
        while b < high and text[b] in WORD and text[b - 1] in WORD:
            b += 1
        if whole and a == low:
            a = whole.pop()[0]
        whole.append((a, b))
    return whole


def cases_of(text: str, zone: tuple[int, int], gold: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The zone in training cases of about ``WIDEST`` characters, cut at white space outside the right spans."""
    out, (a, end) = [], zone
    spans = sorted((s, e) for s, e, _ in gold)
    while end - a > WIDEST:
        b = a + WIDEST
        while b < min(end, a + 2 * WIDEST) and (not text[b].isspace() or any(s < b < e for s, e in spans)):
            b += 1
        out.append((a, b))
        a = b
    return out + [(a, end)] * (a < end)


FEATURES = ("bias", "few_digits", "digits_9_11", "digits_12_19", "many_digits", "luhn", "four_parts", "part_over_255", "address_shape", "no_at",
            "plus", "no_plus", "double_zero", "space", "letters", "letters_and_digits", "odd_character", "unbalanced", "inside_left", "inside_right",
            "other_start", "other_end", "groups_2_5", "one_group", "dots_only", "calls", "pays", "writes", "grows_left", "grows_right", "groups_3_3_4", "groups_of_4", "cut_left", "spelled_shape", "other_shape", "label_follows", "digits_follow", "digits_before")


def features(text: str, a: int, b: int) -> np.ndarray:
    """Features of the whole span text[a:b]."""
    s = text[a:b]
    d = digits_of(s)
    groups = re.findall("[0-9]+", s)
    letters = any(c.isalpha() for c in s)
    parts = re.split(DOT, s)
    four = len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts)
    shape = bool(SPELLED.fullmatch(s))
    left, right = text[a - 1:a], text[b:b + 1]
    before = text[max(0, a - 24):a].lower()
    n = len(d)
    x = [1, n < 4, 9 <= n <= 11, 12 <= n <= 19, n > 19, 12 <= n <= 19 and luhn(d), four, four and any(int(p) > 255 for p in parts), shape, not AT.search(s),
         s[:1] == "+", s[:1] != "+", s[:2] == "00", " " in s, letters, letters and n > 0, not re.fullmatch(r"[\w\s.@+()\[\]{}<>%-]*", s),
         s.count("(") != s.count(")") or s.count("[") != s.count("]"), left.isalnum(), right.isalnum(),
         not (s[:1].isalnum() or s[:1] in "+("), not s[-1:].isalnum(), not letters and 2 <= len(groups) <= 5, not letters and len(groups) == 1,
         not letters and bool(re.fullmatch(r"[0-9.]+", s)), bool(re.search(r"\b(?:tel|phone|call|fax|mobile)\b", before)),
         bool(re.search(r"\b(?:card|visa|credit|pan)\b", before)), bool(re.search(r"\b(?:e-?mail|mail|contact|write)\b", before)),
         left in tuple("._%+-@"), right in tuple("@-") or (right == "." and text[b + 1:b + 2].isalnum()),
         not letters and [len(g) for g in groups[-3:]] == [3, 3, 4], not letters and n >= 12 and len(groups) > 1 and {len(g) for g in groups[:-1]} == {4},
         not letters and left in tuple("+(") or left == "0" and s[:1] == "0", shape and " " in s, letters and not shape,
         letters and bool(NEXT_LABEL.match(text, b)), not letters and bool(NEXT_DIGITS.match(text, b)), not letters and not (12 <= n <= 19 and luhn(d)) and bool(LAST_DIGITS.search(text[max(0, a - 4):a]))]
    return np.array(x, dtype=np.float64)


def borders_of(text: str, zone: tuple[int, int]) -> list[int]:
    return [m.start() for m in TOKEN.finditer(text, zone[0], zone[1])] + [zone[1]]


def addresses(text: str, borders: list[int]) -> dict[int, int]:
    """First token and end of each whole spelled-out address, whatever its length."""
    out = {}
    for m in WHOLE.finditer(text, borders[0], borders[-1]):
        a, b = m.start(), m.end()
        while not (text[a].isalnum() or text[a] == "+"):
            a += 1
            if a == b:
                break
        while b > a and not text[b - 1].isalnum():
            b -= 1
        i, j = bisect_left(borders, a), bisect_left(borders, b)
        if a < b and borders[i] == a and borders[j] == b:
            out[i] = j
    return out


def segments(text: str, borders: list[int], first: int, last: int, long: dict[int, int] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(candidate segments that start at tokens first to last, as token ranges; their features): spans that begin and end like data.

    ``long`` are the zone's ``addresses``. Over ``LONGEST`` tokens, only numbers (4 to 19 digits, no word but "dot") and
    addresses by their shape are candidates.
    """
    if long is None:
        long = addresses(text, borders)
    # Ends of words and digit groups and the digits up to them, as far as this block's segments reach.
    ends, digits, words, before = [], [], [], {}
    count, letters, more = 0, 0, 0
    for t in range(first, len(borders) - 1):
        if t < last:
            before[t] = count, letters
        elif more > LONGEST:
            break
        c = text[borders[t]]
        if "0" <= c <= "9":
            count += borders[t + 1] - borders[t]
        elif c.isalpha():
            letters += text[borders[t]:borders[t + 1]] != "dot"
        if text[borders[t + 1] - 1].isalnum():
            ends.append(t + 1)
            digits.append(count)
            words.append(letters)
            more += t >= last
    spans, rows = [], []
    for i in range(first, last):
        a = borders[i]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        p = bisect_left(ends, i + 1)
        near = ends[p:p + LONGEST]
        at = AT.search(text, a, borders[near[-1]]) if near else None
        n0, w0 = before[i]
        for j, n, w in zip(near, digits[p:p + LONGEST], words[p:p + LONGEST], strict=True):
            b = borders[j]
            spelled = at is not None and b >= at.end()
            if j - i <= LONGEST:
                fits = b - a >= 5 and (spelled or n - n0 >= 4)
            else:
                fits = bool(SPELLED.fullmatch(text, a, b)) if spelled else w == w0 and 4 <= n - n0 <= 19
            if fits:
                spans.append((i, j))
                rows.append(features(text, a, b))
        if near and long.get(i, 0) > near[-1]:
            spans.append((i, long[i]))
            rows.append(features(text, a, borders[long[i]]))
    return spans, np.array(rows) if rows else np.zeros((0, len(FEATURES)))


def _sums(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums over segmentations of n tokens."""
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(spans):
        starts.setdefault(i, []).append(k)
        ends.setdefault(j, []).append(k)
    total = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
    f, b = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, n + 1):
        f[t] = f[t - 1]
        for k in ends.get(t, ()):
            f[t] = np.logaddexp(f[t], f[spans[k][0]] + total[k])
    for t in range(n - 1, -1, -1):
        b[t] = b[t + 1]
        for k in starts.get(t, ()):
            b[t] = np.logaddexp(b[t], total[k] + b[spans[k][1]])
    return f, b


def posteriors(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Posterior probability of every (segment, kind)."""
    f, b = _sums(n, spans, scores)
    i, j = (np.array([s[x] for s in spans], dtype=int) for x in (0, 1))
    return np.exp(f[i][:, None] + scores + b[j][:, None] - f[n]) if len(spans) else np.zeros((0, len(KINDS)))


def best_segments(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best segmentation; on equal scores fewer segments win."""
    ends: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(spans):
        ends.setdefault(j, []).append(k)
    top, kind = (scores.max(axis=1), scores.argmax(axis=1)) if len(spans) else ((), ())
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for k in ends.get(t, ()):
            if (s := best[spans[k][0]] + top[k]) > best[t]:
                best[t], back[t] = s, k
    out, t = [], n
    while t:
        if back[t] < 0:
            t -= 1
        else:
            out.append((back[t], int(kind[back[t]])))
            t = spans[back[t]][0]
    return out[::-1]


def rewritten(text: str, spans: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its base spans written in ways that the patterns miss."""
    out, moved, last = [], [], 0
    size = 0
    for a, b, kind in spans:
        if a < last:
            continue
        s = text[a:b]
        way = int(rng.integers(3))
        if kind == "email":
            s = s.replace("@", (" at ", " [at] ", "(at)")[way])
            if way < 2:
                local, _, domain = s.rpartition((" at ", " [at] ")[way])
                s = local + (" at ", " [at] ")[way] + domain.replace(".", (" dot ", " [dot] ")[way])
        elif kind == "ip":
            s = s.replace(".", ("[.]", " . ", "(.)")[way])
        elif kind == "card":
            d = digits_of(s)
            s = (".", " - ", "/", "_")[int(rng.integers(4))].join(d[i:i + 4] for i in range(0, len(d), 4))
        else:
            s = (s[1:].lstrip("0123456789 "), "00" + s[1:], s[1:])[way] or s[1:]
        out += [text[last:a], s]
        size += a - last
        moved.append((size, size + len(s), kind))
        size += len(s)
        last = b
    return "".join(out) + text[last:], moved


class Blocks:
    """Sums and best segmentation of a zone of any length, as ``_sums`` and ``best_segments`` have them, from segments scored by blocks."""

    def __init__(self, text: str, borders: list[int], weights: np.ndarray):
        self.borders, self.n = borders, len(borders) - 1
        self.count = -(-self.n // BLOCK)
        long = addresses(text, borders)

        @lru_cache(maxsize=8)
        def scored(k: int) -> tuple[dict[int, list[tuple[int, int]]], np.ndarray]:
            spans, x = segments(text, borders, k * BLOCK, min(self.n, (k + 1) * BLOCK), long)
            starts: dict[int, list[tuple[int, int]]] = {}
            for row, (i, j) in enumerate(spans):
                starts.setdefault(i, []).append((row, j))
            return starts, x @ weights.T

        self.scored = scored

    def best(self) -> list[tuple[int, int, int, float]]:
        """(first token, end, kind, score) of the best segmentation's segments; on equal scores fewer segments win."""
        best, back = [0.0] + [-np.inf] * self.n, [None] * (self.n + 1)
        for block in range(self.count):
            starts, scores = self.scored(block)
            top, kind = (scores.max(axis=1), scores.argmax(axis=1)) if len(scores) else ((), ())
            for t in range(block * BLOCK, min(self.n, (block + 1) * BLOCK)):
                for row, j in starts.get(t, ()):
                    if (s := best[t] + top[row]) > best[j]:
                        best[j], back[j] = s, (t, int(kind[row]), float(top[row]))
                if best[t] >= best[t + 1]:
                    best[t + 1], back[t + 1] = best[t], None
        out, t = [], self.n
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, kind, score = back[t]
                out.append((i, t, kind, score))
                t = i
        return out[::-1]

    def covered(self, i: int, j: int, kind: int, sums: tuple[np.ndarray, np.ndarray]) -> float:
        """Probability that the middle token of tokens i to j lies in a segment of this kind.

        Segments over one token exclude each other, so their marginals add up: where the exact borders are
        unsure, the kind need not be. Segments that start more than ``REACH`` tokens before are left out.
        """
        f, b = sums
        middle, total = (i + j) // 2, -np.inf
        for t in range(max(0, min(i, middle - REACH)), middle + 1):
            starts, scores = self.scored(t // BLOCK)
            for row, end in starts.get(t, ()):
                if end > middle:
                    total = np.logaddexp(total, f[t] + scores[row, kind] + b[end])
        return float(np.exp(total - f[-1]))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log sums over segmentations."""
        f, b = np.full(self.n + 1, -np.inf), np.zeros(self.n + 1)
        f[0] = 0.0
        for block in range(self.count):
            starts, scores = self.scored(block)
            total = np.logaddexp.reduce(scores, axis=1)
            for t in range(block * BLOCK, min(self.n, (block + 1) * BLOCK)):
                for row, j in starts.get(t, ()):
                    f[j] = np.logaddexp(f[j], f[t] + total[row])
                f[t + 1] = np.logaddexp(f[t + 1], f[t])
        for block in range(self.count - 1, -1, -1):
            starts, scores = self.scored(block)
            total = np.logaddexp.reduce(scores, axis=1)
            for t in range(min(self.n, (block + 1) * BLOCK) - 1, block * BLOCK - 1, -1):
                b[t] = b[t + 1]
                for row, j in starts.get(t, ()):
                    b[t] = np.logaddexp(b[t], total[row] + b[j])
        return f, b


class PrivateModel:
    def __init__(self, weights: np.ndarray | None):
        self.weights = weights

    def added(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        if self.weights is None:
            return []
        out = []
        starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
        for zone in zones(text):
            blocks = Blocks(text, borders_of(text, zone), self.weights)
            borders, sums = blocks.borders, None
            for i, j, kind, _ in blocks.best():
                a, b = borders[i], borders[j]
                before = bisect_left(starts, b)
                if before and ends[before - 1] > a:
                    continue
                if sums is None:
                    sums = blocks.sums()
                if blocks.covered(i, j, kind, sums) >= SURE:
                    out.append((a, b, KINDS[kind]))
        return out


def train(texts: list[str], rounds: int = 60, most: int = TRAIN_ZONES, seed: int = 5) -> PrivateModel:
    """Weights by gradient steps on the likelihood of the right segmentations of the sample's zones."""
    rng = np.random.default_rng(seed)
    cases = []
    for text in texts:
        base = base_spans(text)
        for t, gold in [(text, base)] + [rewritten(text, base, rng) for _ in range(REWRITINGS if base else 0)]:
            for zone in (c for z in zones(t) for c in cases_of(t, z, gold)):
                if len(cases) >= most:
                    break
                borders = borders_of(t, zone)
                spans, x = segments(t, borders, 0, len(borders) - 1)
                if not spans:
                    continue
                at = {borders[i]: i for i in range(len(borders))}
                index = {s: k for k, s in enumerate(spans)}
                y = np.zeros((len(spans), len(KINDS)))
                last = -1
                for a, b, kind in gold:
                    k = index.get((at.get(a, -1), at.get(b, -1)))
                    if k is not None and a >= last:
                        y[k, KINDS.index(kind)] = 1
                        last = b
                cases.append((len(borders) - 1, spans, x, y))
    if not any(y.any() for *_, y in cases):
        return PrivateModel(None)
    w, g2 = np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -2.0
    for _ in range(rounds):
        grad = -0.02 * w
        for n, spans, x, y in cases:
            grad += (y - posteriors(n, spans, x @ w.T)).T @ x
        g2 += grad ** 2
        w += 0.8 * grad / (np.sqrt(g2) + 1e-6)
    return PrivateModel(w)


def training_sample(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Distinct texts of the ``rows`` rows with a digit cluster or an at-sign that have the smallest hashes of the id, 64 MB at most."""
    likely = docs.where(F.col(id_col).isNotNull() & F.col(text_col).cast("string").rlike(r"@|[0-9][0-9 ().-]{6,}[0-9]"))
    got = hash_sample(likely, {None: likely.count()}, rows, key=id_col, text=text_col).toPandas()
    return list(dict.fromkeys(got.sort_values("hash")["text"]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 600) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs, train_rows, id_col, text_col)))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                base = [base_spans(t) for t in strings(part)]
                more = [model.value.added(t, b) for t, b in zip(strings(part), base, strict=True)]
                both = [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id")] + [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                    + [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(b) for b in both], pa.string()),
                       pa.array([len(m) for m in more], pa.int64())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(arrow, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base patterns, and spans that a semi-Markov field adds."""
    return find_private(read_table(spark, sf_dir, "documents"))
