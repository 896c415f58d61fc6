"""Audit of filters that fail the same documents, by count-weighted decision diagrams.

Every document gets a mask of the filters that it fails. The masks of a part are counted, and their
counts (documents, good ones, toxic ones) form a decision diagram: one level per filter, a passing and a
failing branch per node, equal nodes stored once, each with the counts of all masks
below. In the diagram of an order of filters, the path on which every filter passes gives the order's
steps: what the failing branch of its k-th node holds is removed by the k-th filter. The other orders come from
that diagram by exchanging neighbouring levels, one exchange per order, as every order follows from the one before
by one such exchange.

The masks come from one pass over the texts. Then only (id, part, mask, digest) move: for
labels by id, for copies by digest, the rows of a digest summed per part before they meet, so
a text that a third of all rows have is no hot key. At most 32 masks are left of a part, and parts
are diagrammed side by side.

Null texts are empty, null parts the empty string. A null id is larger than every other and has no
label; of several labels for an id the largest count. Rows are counted one by one, also where they repeat. An empty
table gives an empty result; other columns are ignored. Long texts are split into words in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weekcraft.llm.common import arrow, column, read_table, steps, strings

#: Fixed values of the filters: least words, least share of distinct words, most capitals (of 100 characters), marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
FILTERS = "ABCDE"
BLOCK = 4_000_000

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\v\f\r"


def word_numbers(data: bytes) -> tuple[int, int]:
    """(words, distinct words); ``bytes.split`` cuts at space, tab, line feed, vertical tab, form feed and carriage return."""
    if len(data) <= BLOCK:
        words = data.split()
        return len(words), len(set(words))
    total, met, at = 0, set(), 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and data[end] not in _BLANKS:
            end += 1
        words = data[at:end].split()
        total += len(words)
        met.update(words)
        at = end
    return total, len(met)


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails, A the lowest."""
    data = text.encode("utf-8")
    words, distinct = word_numbers(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUATION))
    return ((words < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * words) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2
            | (len(data.translate(None, MARKS)) < len(data)) << 3)


# --- diagrams ------------------------------------------------------------------------------

class Diagram:
    """A decision diagram over filters with counts at its leaves; ``order`` lists its levels from the top.

    A node is (passing child, failing child, counts); equal nodes are one object. A leaf is its counts.
    """

    def __init__(self, masks: dict[int, tuple[int, ...]], order: str = FILTERS):
        self.order = order
        self.width = len(next(iter(masks.values()))) if masks else 1
        self._nodes: dict[tuple, tuple] = {}
        self.root = self._build(masks, 0)

    def _build(self, masks: dict[int, tuple[int, ...]], level: int):
        if level == len(self.order):
            return self._leaf(tuple(map(sum, zip(*masks.values(), strict=True))) if masks else (0,) * self.width)
        bit = 1 << FILTERS.index(self.order[level])
        return self._node(self._build({m: c for m, c in masks.items() if not m & bit}, level + 1),
                          self._build({m: c for m, c in masks.items() if m & bit}, level + 1))

    def _leaf(self, counts: tuple[int, ...]) -> tuple:
        return self._nodes.setdefault(("leaf", counts), (None, None, counts))

    def _node(self, passed: tuple, failed: tuple) -> tuple:
        key = (id(passed), id(failed))
        if key not in self._nodes:
            self._nodes[key] = (passed, failed, tuple(map(sum, zip(passed[2], failed[2], strict=True))))
        return self._nodes[key]

    def swap(self, level: int) -> None:
        """Exchange the levels ``level`` and ``level + 1``; nodes above are made anew, those below are kept."""
        done: dict[int, tuple] = {}

        def down(node: tuple, at: int) -> tuple:
            if id(node) not in done:
                passed, failed, _ = node
                if at < level:
                    done[id(node)] = self._node(down(passed, at + 1), down(failed, at + 1))
                else:
                    done[id(node)] = self._node(self._node(passed[0], failed[0]), self._node(passed[1], failed[1]))
            return done[id(node)]

        self.root = down(self.root, 0)
        o = self.order
        self.order = o[:level] + o[level + 1] + o[level] + o[level + 2:]

    def path(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Per level on the path where every filter passes: counts of the passing and of the failing branch."""
        out, node = [], self.root
        for _ in self.order:
            out.append((node[0][2], node[1][2]))
            node = node[0]
        return out


def exchanges(n: int) -> Iterator[int]:
    """Levels to exchange with the next one so that all orders of n levels are met, each once (plain changes)."""
    if n < 2:
        return
    below, down = list(exchanges(n - 1)), True
    for k in range(len(below) + 1):
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if k < len(below):
            yield below[k] + (1 if down else 0)
        down = not down


def audit_masks(masks: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    masks: failure mask -> (documents, good, toxic).
    """
    failing = {f: sum(c[0] for m, c in masks.items() if m >> i & 1) for i, f in enumerate(FILTERS)}
    alone = {f: masks.get(1 << i, (0,))[0] for i, f in enumerate(FILTERS)}
    diagram = Diagram(masks)
    steps_of = {diagram.order: diagram.path()}
    for level in exchanges(len(FILTERS)):
        diagram.swap(level)
        steps_of[diagram.order] = diagram.path()
    assert len(steps_of) == len(set(permutations(FILTERS)))
    shapley = dict.fromkeys(FILTERS, 0)
    for order, path in steps_of.items():
        for f, (_, failed) in zip(order, path, strict=True):
            shapley[f] += failed[0]
    return [(order, k + 1, passed[0], failed[0], failing[f] - failed[0], alone[f], failed[1], failed[2], shapley[f])
            for order, path in steps_of.items() for k, (f, (passed, failed)) in enumerate(zip(order, path, strict=True))]


# --- on tables -----------------------------------------------------------------------------

def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row: doc_id, part, mask of A to D, digest of the text (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch):
                texts = strings(piece)
                yield pa.RecordBatch.from_arrays([
                    column(piece, "doc_id"), column(piece, "part"), pa.array([text_mask(t) for t in texts], pa.int32()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).digest() for t in texts], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("text")).transform(arrow, run, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask of A to E, n, good, toxic): at most 32 rows per part."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = (failure_masks(docs, id_col, text_col, part_col).join(marks, "doc_id", "left")
            .withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}))
    # Rows with one id and text are first counted, so that the least id of a digest comes with its rows.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    by_id = rows.groupBy("digest", "part", "good", "toxic", "doc_id").agg(F.first("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
    per_part = by_id.groupBy("digest", "part", "good", "toxic").agg(F.first("mask").alias("mask"), F.sum("n").alias("n"),
                                                                   F.min(F.struct(rank.alias("rank"), F.col("n"))).alias("least"))
    first = F.col("least.rank") == F.min("least.rank").over(Window.partitionBy("digest"))
    split = per_part.withColumn("passing", F.when(first, F.col("least.n")).otherwise(F.lit(0)))
    copies = F.col("n") - F.col("passing")
    both = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), copies.alias("n")))).alias("c"))
    return (both.where(F.col("c.n") > 0).groupBy("part", F.col("c.mask").alias("mask"))
            .agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("bad")))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["bad"], strict=True)}
        out = pd.DataFrame(audit_masks(masks), columns=columns)
        out.insert(0, "part", key[0])
        return out

    return mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(
        run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction of five filters per language, in all orders, from decision diagrams of failure masks."""
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLE = {"op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, doc_id, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(least < doc_id, least IS NOT NULL AND doc_id IS NULL)] AS fails FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
      WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
s AS (SELECT o, i AS step, list_transform(o, lambda k: substr('ABCDE', CAST(k AS INT), 1)) AS letters FROM o, x),
r AS (SELECT part, o, array_to_string(letters, '') AS filter_order, step, o[step] AS f,
        len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS before, fails[o[step]] AS now, len(list_filter(fails, lambda v: v)) AS failures, n, good, toxic FROM m, s),
a AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT before AND NOT now), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT before AND now), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE before AND now), 0) AS redundant, coalesce(sum(n) FILTER (WHERE now AND failures = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE NOT before AND now), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT before AND now), 0) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a
"""}
