"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may go without and gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="routeflow-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later uses see the same rows, even after an executor is lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def move_into(spark: SparkSession, source: str, target: str) -> None:
    """Renames the data files of a folder that Spark wrote into another folder of the same store, and deletes what is left of it.
    Names are unique, so that a call that was cut off can be made again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path(source)):
        return
    store.mkdirs(path(target))
    for status in store.listStatus(path(source)):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")) and not store.rename(status.getPath(), path(f"{target}/{name}")):
            raise OSError(f"{target}/{name} can't be made")
    store.delete(path(source), True)
