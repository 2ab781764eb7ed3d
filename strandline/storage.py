"""Tables in the folder that all executors share, to cut lineage in iterative work."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only a local session may do without, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "strandline-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _at(spark: SparkSession, path: str):
    """A path and the file system that it lies in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _app_dir(spark: SparkSession) -> str:
    """This application's own folder; the driver's file system deletes it when it ends."""
    path = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"
    at, system = _at(spark, path)
    if not system.exists(at):
        system.mkdirs(at)
        system.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, buckets: tuple[int, str] | None = None) -> DataFrame:
    """df as Parquet in the shared folder, read again: the files outlive lost executors.  drop_written deletes them.

    buckets: number and column by which the files are dealt, so that joins on that column needn't shuffle them again.
    Within scratch() the table goes when the scope ends, unless it is kept.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table = f"strandline_{uuid.uuid4().hex}" if buckets else None
    if buckets:
        df.write.bucketBy(*buckets).sortBy(buckets[1]).option("path", path).format("parquet").saveAsTable(table)
    else:
        df.write.parquet(path)
    out = spark.table(table) if buckets else spark.read.schema(df.schema).parquet(path)
    out._strandline_path, out._strandline_table = path, table
    scopes = getattr(_scopes, "stack", [])
    if scopes:
        scopes[-1][path] = out
    return out


def drop_written(df: DataFrame) -> None:
    path = getattr(df, "_strandline_path", None)
    if path:
        if df._strandline_table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._strandline_table}")
        at, system = _at(df.sparkSession, path)
        system.delete(at, True)


@contextmanager
def scratch() -> Iterator:
    """A scope whose written tables are dropped at its end, but for those that keep() was called with.

    A kept table belongs to the scope around, if there is one.
    """
    _scopes.stack = getattr(_scopes, "stack", [])
    own: dict[str, DataFrame] = {}
    _scopes.stack.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.pop(df._strandline_path, None)
        if len(_scopes.stack) > 1:
            _scopes.stack[-2][df._strandline_path] = df
        return df

    try:
        yield keep
    finally:
        _scopes.stack.pop()
        for df in own.values():
            drop_written(df)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage: Spark deletes a shuffle's files when its last plan has been collected.

    Of use between large steps, where disk is scarce; nothing depends on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions, at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
