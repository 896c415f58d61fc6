"""The corpus pipeline: filter, deduplicate, mix and tokenise documents.

Each stage works on all that its predecessor kept. Its result is written as Parquet to a fresh folder
below ``spark.checkpoint.dir`` and read again as the next one's documents, and removed when that one is written. The stages but the last
return the columns of documents; the last returns one row per document of the mix with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekcraft.llm import exact, jaccard, mixing, toxicity, viterbi
from weekcraft.llm.common import read_table
from weekcraft.session import drop_stage, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, learned from ``labels``, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text."""
    # Fewer remembered segments than alone: Python workers of earlier stages still hold memory here.
    return viterbi.encode_texts(docs, remembered=100_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: No SQL: the toxicity field and the cube method are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
        if before is not None:
            drop_stage(before)  # the next stage is written
        before = docs
    return docs
