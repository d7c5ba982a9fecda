"""Reviews of a stream of saved files, with results that replace each other by path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.scratch import file_system
from verdigris.streaming.replace_log import ReplaceLog
from verdigris.streaming.timers import QUIET_MS, debounce, debounce_by, timer

__all__ = ["QUIET_MS", "clear", "debounce", "debounce_by", "latest", "read_current", "replace_by_path", "results", "review_stream", "timer"]

def latest(files: DataFrame) -> DataFrame:
    """The last version of every path in a batch."""
    return files.groupBy("path").agg(F.max_by(F.struct("source", "mtime"), F.struct("mtime", "source")).alias("f")).select("path", "f.*")


def results(spark: SparkSession, table: str) -> ReplaceLog:
    """The log of findings by path that a stream writes to the folder table."""
    return ReplaceLog(spark, table)


def replace_by_path(spark: SparkSession, table: str, reviewed: DataFrame, findings: DataFrame, batch_id: int | None = None) -> None:
    """The findings of the reviewed paths take the place of earlier ones. A batch that is run again changes nothing; one that fails leaves
    the paths as the batch before it did."""
    results(spark, table).append(reviewed, findings, batch_id)


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """Findings of the last batch that reviewed each path."""
    return results(spark, table).current()


def clear(spark: SparkSession, table: str) -> None:
    """Drops all results."""
    results(spark, table).clear()


def first_batch(spark: SparkSession, table: str, checkpoint: str) -> int:
    """The log's number of a stream's batch 0, kept with the stream's checkpoint: a stream with a new checkpoint counts from 0 again, and its
    results come after all that are there."""
    kept = f"{checkpoint.rstrip('/')}/first-batch"
    where, fs = file_system(spark, f"{kept}/_SUCCESS")
    if not fs.exists(where):
        n = results(spark, table).next_seq()
        spark.range(n, n + 1, numPartitions=1).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept).first()[0]


def review_stream(files: DataFrame, table: str, checkpoint: str, on_error: Callable[[DataFrame, int], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Starts reviewing a stream of files (path, source, mtime) into table. A file that cannot be parsed disturbs no other."""
    from verdigris.operators.report import errors, review

    first = first_batch(files.sparkSession, table, checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        own = latest(df).persist()
        try:
            replace_by_path(df.sparkSession, table, own, review(own), first + batch_id)
            if on_error is not None:
                on_error(errors(own), batch_id)
        finally:
            own.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
