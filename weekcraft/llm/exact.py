"""Exact deduplication by a two-pass Bloom filter.

Pass one hashes every normalised text and marks, in a Bloom filter, the bit positions that
two or more rows set. In pass two a row whose positions are not all marked cannot have an
equal: it passes straight through. Only the other rows are shuffled, grouped by the full
SHA-256 of the normalised text, so false positives of the filter change nothing but cost.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; a null text is
the empty text, so null, empty and blank texts are one group. Of equal texts the row with the
most code points stays, then the smallest doc_id (null ids last); of fully repeated rows
exactly one. An empty table gives an empty result; other columns are ignored (``exact_groups``)
or passed on unchanged (``drop_copies``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcraft.llm.common import SPACE, build_filter, filter_bits, filter_column, read_table, text_of
from weekcraft.session import materialize


def _digest(text: str):
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), f"{SPACE}+", "").cast("binary"), 256))


def _key(digest):
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _maybe_repeated(spark: SparkSession, keys: DataFrame, most_bits: int):
    rows = keys.count()
    return filter_column(spark, build_filter(keys, filter_bits(rows, most=most_bits), least=2))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the group's size (partial sums before the shuffle)."""
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_uid").alias("uid")))
    return rows.groupBy("_sha").agg(best.alias("_best"), F.count(F.lit(1)).alias("_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Only (id, length, digest) are kept of a row, written once; a third of all rows in one group
    costs one row per task in the grouping, and the join back is split by AQE.
    """
    spark = docs.sparkSession
    hashed = materialize(docs.select(F.col(id_col).alias("_id"), F.length(text_of(text_col)).alias("_n"), _digest(text_col).alias("_sha"),
                                     F.monotonically_increasing_id().alias("_uid")), "exact_hashes")
    maybe = _maybe_repeated(spark, hashed.select(_key(F.col("_sha")).alias("key")), most_bits)
    marked = hashed.withColumn("_maybe", maybe(_key(F.col("_sha"))))
    alone = marked.where(~F.col("_maybe")).select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
    rows = materialize(marked.where("_maybe").drop("_maybe"), "exact_maybe")
    groups = materialize(_groups(rows), "exact_groups")
    grouped = rows.join(groups, "_sha").select(
        F.col("_id").alias("doc_id"), F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_best.uid") == F.col("_uid")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that cannot have an equal never leave their task; the possibly repeated rows are
    written once with an id of their own and joined with the rows that stay.
    """
    spark = docs.sparkSession
    # The row as one struct: columns named like those added here stay apart.
    hashed = docs.select(F.struct("*").alias("_doc"), _digest(text_col).alias("_sha"))
    keys = materialize(hashed.select(_key(F.col("_sha")).alias("key")), "exact_keys")
    maybe = _maybe_repeated(spark, keys, most_bits)
    marked = hashed.withColumn("_maybe", maybe(_key(F.col("_sha"))))
    rows = materialize(marked.where("_maybe").drop("_maybe").withColumn("_uid", F.monotonically_increasing_id()), "exact_rows")
    groups = _groups(rows.select("_sha", F.length(text_of(f"_doc.{text_col}")).alias("_n"), F.col(f"_doc.{id_col}").alias("_id"), "_uid"))
    stay = groups.select(F.col("_best.uid").alias("_uid"))
    return marked.where(~F.col("_maybe")).select("_doc.*").unionByName(rows.join(stay, "_uid", "leftsemi").select("_doc.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup: group and kept row of every document, by a two-pass Bloom filter."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE = {"op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY h) AS n
      FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""}
