"""Token counts of a piece model without ids: distinct pre-tokens are counted once.

A SentencePiece text becomes a leading space, then the text, with spaces as visible marks. A
pre-token is a run of marks with the characters up to the next mark. No piece of the model has a
mark after another character (checked when the model is loaded), so no merge crosses a pre-token's
borders, and the tokens of a text are those of its pre-tokens taken alone.

One pass collects the distinct pre-tokens with their frequencies; each is encoded once and its
number of pieces kept. A second pass forms per-document pre-token frequencies and joins them with
that table. The join is exact in two parts: pre-tokens that occur at least T times (T is the least
power of two that leaves at most ``most_common`` of them) come as a broadcast dictionary of bounded
size, and all others go through a shuffle join, so a common word never becomes a hot key.

A null or empty text has 0 tokens. Rows are counted one by one, also where ids repeat. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import arrow, column, read_table, steps, strings, tokenizer_path
from weekcraft.session import materialize

MODEL = "piece_bpe_32k.model"
#: Size bound of the broadcast dictionary: entries, and characters of an entry.
MOST_COMMON, MOST_CHARS = 1 << 19, 48
MARK = "▁"

_models: dict[str, object] = {}


def processor(path: str):
    """The SentencePiece model, loaded once a process; refuses one whose pieces cross pre-tokens."""
    if path not in _models:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
            raise ValueError(f"pieces of {path} cross the borders of pre-tokens")
        _models[path] = sp
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first mark and with spaces for the other marks."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [t[1:] for t in re.findall(" +[^ ]*", " " + text)]


def piece_counts(sp, tokens: list[str]) -> list[int]:
    return [len(ids) if t else 1 for t, ids in zip(tokens, sp.encode(tokens, num_threads=1), strict=True)]


def distinct_pre_tokens(docs: DataFrame, text_col: str = "text", held: int = 400_000) -> DataFrame:
    """(token, occurrences), each task summing up to ``held`` distinct tokens before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in steps(batch):
                for text in strings(part):
                    counts.update(pre_tokens(text))
                if len(counts) > held:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    def rows(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return (docs.select(F.col(text_col).cast("string").alias("text")).transform(arrow, run, "token string, n long")
            .groupBy("token").agg(F.sum("n").alias("occurrences")))


def counted_pre_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """(token, occurrences, pieces): every distinct pre-token encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            for part in steps(batch, "token"):
                yield pa.RecordBatch.from_arrays([column(part, "token"), column(part, "occurrences"), pa.array(piece_counts(sp, strings(part, "token")), pa.int32())],
                                                 names=["token", "occurrences", "pieces"])

    return tokens.transform(arrow, run, "token string, occurrences long, pieces int")


def common_dictionary(counted: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the pre-tokens with at least T occurrences, T being the least power of two that leaves ``most`` at most."""
    short = counted.where(F.length("token") <= MOST_CHARS)
    power = F.floor(F.log2(F.col("occurrences").cast("double"))).cast("int")
    left, least = most, None
    for r in short.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("p").desc()).collect():
        if (left := left - r["n"]) < 0:
            break
        least = r["p"]
    if least is None:
        return {}
    return {r["token"]: r["pieces"] for r in short.where(F.col("occurrences") >= 2 ** least).select("token", "pieces").collect()}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096,
                 most_common: int = MOST_COMMON) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    path = path or tokenizer_path(MODEL)
    counted = materialize(counted_pre_tokens(distinct_pre_tokens(docs, text_col), path), "pre_tokens")
    common = spark.sparkContext.broadcast(common_dictionary(counted, most_common))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document a row with the sum over the common pre-tokens, and a row for each other pre-token."""
        get = common.value.get
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in steps(batch):
                at, tokens, numbers, ids = [], [], [], []
                for doc, text in zip(column(part, "doc_id").to_pylist(), strings(part), strict=True):
                    found = pre_tokens(text)
                    pieces = [get(t, 0) for t in found]
                    at.append(row)
                    ids.append(doc)
                    tokens.append(None)
                    numbers.append(sum(pieces))
                    rest = Counter(t for t, n in zip(found, pieces, strict=True) if not n)
                    at.extend([row] * len(rest))
                    ids.extend([None] * len(rest))
                    tokens.extend(rest)
                    numbers.extend(rest.values())
                    row += 1
                at_text = {r: b for r, b in zip((r for r, t in zip(at, tokens, strict=True) if t is None),
                                                pa.compute.fill_null(pa.compute.binary_length(column(part, "text")), 0).to_pylist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64()),
                                                  pa.array([at_text[r] if t is None else None for r, t in zip(at, tokens, strict=True)], pa.int64()),
                                                  pa.array(tokens, pa.string()), pa.array(numbers, pa.int64())], names=["row", "doc_id", "n_bytes", "token", "n"])

    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                       .transform(arrow, frequencies, "row long, doc_id long, n_bytes long, token string, n long"), "frequencies")
    rest = (rows.where(F.col("token").isNotNull()).select("row", "token", "n").join(counted.select("token", "pieces"), "token")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("_rest")))
    total = F.col("n") + F.coalesce(F.col("_rest"), F.lit(0))
    return (rows.where(F.col("token").isNull()).join(rest, "row", "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text by its pre-tokens, for the 32k piece model."""
    return token_counts(read_table(spark, sf_dir, "documents"))
