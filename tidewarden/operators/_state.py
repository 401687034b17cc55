"""Cutting lineage in the folder that all machines of a cluster share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the context or of ``spark.checkpoint.dir``.

    Where neither is set, a folder of our own on a local master; on a cluster that is an error.
    """
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any store that Spark writes to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*spent: DataFrame) -> None:
    """Deletes the tables of checkpoints that nothing reads any more; other frames are left alone."""
    for df in spent:
        path = df.__dict__.pop("_table", None)
        if path:
            delete(df.sparkSession, path)
            for names in _scopes:
                if path in names:
                    names.remove(path)


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """Checkpoints made inside that are still there at its end are deleted then: nothing lazy that reads them may outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it ends: the driver's garbage collection finds them a checkpoint or two late."""
    if not spark.conf.isModifiable(_END):
        yield
        return
    before = spark.conf.get(_END)
    spark.conf.set(_END, "true")
    try:
        yield
    finally:
        spark.conf.set(_END, before)


def checkpoint(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared folder and read from there; then the tables of ``spent`` ones go.

    A lost executor costs its running tasks only. What was cut off is dropped, so that its shuffle
    files can go too; tables that are still there when the driver ends are deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    if _scopes:
        _scopes[-1].append(path)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_table"] = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    drop(*spent)
    return out
