"""Publishing several tables by one commit (§2.12: write to a staging path, then swap).

A store is a folder. A load writes the partitions it replaces below a folder of its own; the manifest
``manifest.json`` names, for every table and partition, the folder that holds it now. The commit is one atomic rename of a
new manifest over the old one. So readers see all tables before the load or all after it, a load that
stops anywhere before the rename leaves nothing but an unread folder, and running it again repeats it. Partitions
that a load does not touch are neither read nor written.

One writer at a time; the file system must replace a file by renaming (HDFS and local ones do). Folders that no
manifest names any more are removed by ``remove_unused``, once no reader of an earlier manifest is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcraft.session import path_exists, remove_path

MANIFEST = "manifest.json"
#: The partition of a table without a partition column, and of a null value.
WHOLE, NULL = "", "__HIVE_DEFAULT_PARTITION__"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, store: str) -> dict[str, dict[str, str]]:
    """{table: {partition: load}} of the store's last commit; {} before the first."""
    path = f"{store.rstrip('/')}/{MANIFEST}"
    if not path_exists(spark, path):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _commit(spark: SparkSession, store: str, manifest: dict, load: str) -> None:
    new, fs = _files(spark, f"{store}/_manifest.{load}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{store}/{MANIFEST}"), how)


def publish(spark: SparkSession, store: str, tables: dict[str, tuple[DataFrame, str | None]],
            emptied: dict[str, Iterable] | None = None, load: str | None = None) -> str:
    """Replace the partitions that each frame holds (all of it without a partition column), and commit; returns the load's id.

    tables: name -> (rows of the partitions to replace, partition column). ``emptied`` names partition values that a
    delete has left without rows. Every run of a load has a folder of its own, so running it again harms no reader.
    """
    store, load = store.rstrip("/"), f"{load or 'load'}-{uuid.uuid4().hex}"
    manifest = read_manifest(spark, store)
    for name, (df, column) in tables.items():
        folder = f"{store}/{load}/{name}"
        held = manifest.get(name, {}) if column else {}
        if column:
            # The column stays in the files too: a reader takes folders of several loads at once.
            df.withColumn("_partition", F.coalesce(F.col(column).cast("string"), F.lit(NULL))).write.partitionBy("_partition").parquet(folder)
            held = held | {part: load for part in _partitions(spark, folder)}
        else:
            df.write.parquet(folder)
            held = {WHOLE: load}
        for value in (emptied or {}).get(name, ()):
            held.pop(NULL if value is None else str(value), None)
        manifest[name] = held
    _commit(spark, store, manifest, load)
    return load


def _partitions(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _files(spark, folder)
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(n.split("=", 1)[1]) for s in fs.listStatus(path) if "=" in (n := s.getPath().getName())]


def read_published(spark: SparkSession, store: str, name: str, schema, only: Iterable | None = None) -> DataFrame:
    """A table as of the last commit; ``only`` reads the partitions of these values alone.

    Folders of the other partitions are not listed. A table never published has no rows.
    """
    store = store.rstrip("/")
    held = read_manifest(spark, store).get(name, {})
    if only is not None:
        wanted = {NULL if v is None else str(v) for v in only}
        held = {p: load for p, load in held.items() if p in wanted}
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    paths = [f"{store}/{load}/{name}" + (f"/_partition={escape(p)}" if p != WHOLE else "") for p, load in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def remove_unused(spark: SparkSession, store: str) -> list[str]:
    """Remove the folders of loads that the manifest does not name (of unfinished loads too); returns their ids."""
    store = store.rstrip("/")
    used = {load for parts in read_manifest(spark, store).values() for load in parts.values()}
    path, fs = _files(spark, store)
    gone = sorted(n for s in fs.listStatus(path) if s.isDirectory() and (n := s.getPath().getName()) not in used)
    for load in gone:
        remove_path(spark, f"{store}/{load}")
    return gone
