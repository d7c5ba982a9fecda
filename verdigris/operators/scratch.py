"""Tables that a job writes on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_BASE = f"/tmp/verdigris-scratch/{uuid.uuid4().hex}"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below ``spark.checkpoint.dir``, deleted when the process ends. Where that is unset, a local session uses a folder in
    /tmp; a cluster must set it, as its executors would not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _BASE
    path = f"{base.rstrip('/')}/verdigris-{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, and there after executors are lost, until drop() or the end of the process."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._verdigris_scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what keep() wrote and no later plan reads."""
    for t in tables:
        if path := getattr(t, "_verdigris_scratch", None):
            delete(t.sparkSession, path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)
    _MADE.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete(spark, path)
