"""Session helpers: the shared folder, tables that cut lineage, and checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset (a laptop, the tests) a folder of this
    machine is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arborlane-checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the JVM ends."""
    path = f"{shared_dir(spark)}/arborlane-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)  # which only remembers what exists
    return path


def materialise(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, in folders ``by`` a column if given, and read it back.

    The result has no lineage: a lost executor costs a re-read, never a recomputation, and rows that depend on the
    order of a shuffle are fixed once. The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._written_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def collect_shuffles(spark: SparkSession, settle: float = 0) -> None:
    """Let Spark delete the shuffle files of tables that are written and gone: it does so when the driver collects garbage.

    The event of its end holds a query that has just been written; it is gone after ``settle`` seconds. The last query whose
    rows came to the driver is held until the next one.
    """
    time.sleep(settle)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Hint a broadcast where the counted ``rows`` are within ``limit``; beyond it Spark's shuffle join is left to do it."""
    return F.broadcast(df) if rows <= limit else df


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """Partitions to deal data into: the session's shuffle partitions, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def repo_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where the cluster has not installed it (local mode, shared folders)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
