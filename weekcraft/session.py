"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins (runtime broadcast of small sides,
# skew-join splitting) and coalesces small shuffle partitions; the session time zone is
# pinned so date arithmetic matches the oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "weekcraft", extra: dict | None = None) -> SparkSession:
    """Get or create a session with the defaults above (tests and bench use local[N])."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged table rewrites.

    The folder named by ``spark.checkpoint.dir`` (or set with ``SparkContext.setCheckpointDir``)
    is shared storage and is used as is. A session whose driver is also its only executor
    (``local[N]``, as in tests) may leave it unset and gets a scratch folder of its own; on a
    cluster an unset folder is an error, because executors do not share local disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="weekcraft-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the checkpoint folder, unique over sessions, drivers and calls."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as parquet under the checkpoint folder and reading it back.

    One job computes the input once (``Dataset.checkpoint`` would compute it twice unless
    persisted); the written files live in the shared checkpoint folder, so a lost
    executor does not lose them, and the re-read carries file-size statistics that AQE
    uses for join planning. A stage is removed by ``drop_stage``, else when the driver process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    _stages.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df) -> None:
    """Remove the files of a frame that ``materialize`` returned, once nothing reads them any more."""
    spark, path = df.sparkSession, df._stage_path
    remove_path(spark, path)
    _stages.remove((spark, path))


_stages: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_stages() -> None:
    for spark, path in _stages:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove_path(spark, path)
        except Exception:  # the JVM may be gone by now; a leftover stage is harmless
            return
