"""Fixtures shared by the tests of the text operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "word " * 30_000 + "end"

#: Nulls in every column, empty, blank, tiny and very long texts, exact ties, repeated rows and ids.
ODD = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (2, "the cat sat on the  mat and looked at\nthe moon", "en", "a", 46),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n", "de", "b", 3),
    (6, "x", None, "b", 1),
    (7, LONG, "en", None, len(LONG)),
    (8, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (8, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (8, "another text under a repeated id, é中\U0001F600 ▁ end ", "fr", "a", 1),
    (None, "a row without id", "es", "c", 16),
    (None, None, None, None, None),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ["uid", "hash", "key", "row", "score", "bucket", "_sha", "_uid", "_maybe", "token", "kept", "size", "_copies", "node", "held_out"]
    return odd(spark).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def rows(df, *cols):
    got = [tuple(r[c] for c in cols) for r in df.collect()] if cols else [tuple(r) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))
