"""Readers for the driver's parquet tables.

Every read is lazy; ``select``/``filter`` applied later are pushed into the parquet scan
(``ReadSchema`` / ``PushedFilters``) by Catalyst.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """Lazy accessors: ``Tables(spark, sf_dir).lineitem`` is ``spark.read.parquet(...)``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The table as a DataFrame; the reader (file listing, footer schema) runs once per
        ``Tables`` and the same lazy frame is reused by every plan built from it."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._frames[name]

    def sql(self, query: str, args: dict | None = None) -> DataFrame:
        """SRC-4: a parameterised SELECT over the tables (named markers ``:name``).

        Tables referenced as ``{lineitem}``-style placeholders are passed as DataFrame
        arguments, so no global temp view is registered; values go through ``args`` and are
        never spliced into the text.
        """
        frames = {n: self.read(n) for n in TABLE_NAMES if "{" + n + "}" in query}
        return self.spark.sql(query, args=args or {}, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)
