"""Fill-in-the-middle transformation by block rotation in place.

A text of n tokens (runs of ASCII letters, and every other character alone) is cut twice, at token
borders drawn from the sha256 of its id, into prefix, middle and suffix. It is held once, as a
bytearray of its UTF-8 bytes. One scan finds the cuts, the sentinels are inserted before the
segments, which gives ``<P>prefix<M>middle<S>suffix``, and two neighbouring blocks change places by three
reversals: of each block, then of both together. psm exchanges the blocks of middle and suffix, spm the block of
the suffix with all before it. Restoring finds the sentinels again, rotates back with the lengths
exchanged, and deletes the sentinels; the bytes are those of the text.

A text that holds a sentinel stays plain, so the sentinels of an output are its only ones (no sentinel can form
across a border: its first character occurs in it once, and so does its last). Null is the empty text, and plain. A null id
is cut as an id with no digits. Rows are transformed one by one, also where ids repeat; an empty table
gives an empty result; other columns are ignored. Reversals work in blocks, so a very long text needs its own
bytes, one mark per byte for the scan, and 64 KB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, column, read_table, steps, strings

#: The sentinels, the share (of 100) of transformed texts, and the share of spm among them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SPM = 90, 20
BLOCK = 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, ...]:
    """Four numbers of an id: the first 8-digit groups of the hex sha256 of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def token_starts(data: bytes | bytearray) -> np.ndarray:
    """Byte offsets where tokens start: a letter after no letter, or the first byte of any other character."""
    view = np.frombuffer(data, dtype=np.uint8)
    letter = _LETTER[view]
    starts = (view & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def characters(data: bytes | bytearray, start: int, end: int) -> int:
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8)[start:end] & 0xC0) != 0x80))


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place, swapping blocks from both ends."""
    while end - start > 1:
        n = min(BLOCK, (end - start) // 2)
        head = view[start:start + n].copy()
        view[start:start + n] = view[end - n:end][::-1]
        view[end - n:end] = head[::-1]
        start, end = start + n, end - n


def exchange(data: bytearray, start: int, border: int, end: int) -> None:
    """Let the neighbouring blocks [start, border) and [border, end) change places, by three reversals."""
    view = np.frombuffer(data, dtype=np.uint8)
    reverse(view, start, border)
    reverse(view, border, end)
    reverse(view, start, end)


def transform(text: str, doc_id: int | None, seed: int = 1) -> tuple[str, int, int | None, int | None, bytes]:
    """(form, tokens, characters of the prefix, of the middle, output) of one text."""
    data = bytearray(text.encode("utf-8"))
    starts = token_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= TRANSFORMED or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return "plain", n, None, None, bytes(data)
    a, b = (int(starts[k]) if k < n else len(data) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    sizes = characters(data, 0, a), characters(data, a, b)
    data[b:b] = SUFFIX
    data[a:a] = MIDDLE
    data[0:0] = PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < SPM else "psm"
    exchange(data, middle if form == "psm" else 0, suffix, len(data))
    return form, n, *sizes, bytes(data)


def restore(output: bytes | str, form: str) -> str:
    """The exact text, from the output and its form alone."""
    data = bytearray(output.encode("utf-8") if isinstance(output, str) else output)
    if form != "plain":
        prefix, suffix, middle = data.find(PREFIX), data.find(SUFFIX), data.find(MIDDLE)
        if form == "psm":
            # <P>prefix <S>suffix <M>middle: the last two blocks change places.
            exchange(data, suffix, middle, len(data))
        else:
            # <S>suffix <P>prefix <M>middle: the first block goes behind the others.
            exchange(data, 0, prefix, len(data))
        # Now <P>prefix <M>middle <S>suffix; sentinels go from the last to the first.
        for mark in (SUFFIX, MIDDLE, PREFIX):
            at = data.rfind(mark)
            del data[at:at + len(mark)]
    return data.decode("utf-8")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row per row: doc_id, n, form, prefix_chars, middle_chars, output (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                ids = column(part, "doc_id").to_pylist()
                done = [transform(t, i, seed) for t, i in zip(strings(part), ids, strict=True)]
                form, n, prefix, middle, output = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                                                  pa.array(middle, pa.int64()), pa.array([o.decode("utf-8") for o in output], pa.string())],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        arrow, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_texts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fill_in_middle`` with their texts restored, as the column ``restored``."""
    kept = [c for c in rows.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "output"):
                texts = [restore(o, f) for o, f in zip(strings(part, "output"), column(part, "form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "restored"])

    rows = rows.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.transform(arrow, run, f"{schema}, restored string")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every text, and the text restored from it."""
    rows = restored_texts(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLE = {"op11_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
s AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(units[b + 1:n], ''), '') AS z,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM s
"""}
