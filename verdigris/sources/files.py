"""Where source texts come from: folders, rows and streams, always as (path, source, mtime)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.schemas import FILES

#: Files that mark a project's root.
ROOT_MARKS = (".git", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt")


def _files(raw: DataFrame) -> DataFrame:
    """(path, source, mtime) of a binaryFile source; the source is null where the bytes are not UTF-8."""
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return raw.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("source"), F.col("modificationTime").alias("mtime"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """All files below folder that fit the pattern; path is relative to it."""
    rows = _files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder))
    base = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), r"^[a-z0-9]+:/*", "/")
    return rows.withColumn("path", F.when(F.startswith(F.col("path"), base), F.substr(F.col("path"), F.length(base) + 1)).otherwise(F.col("path")))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark.read.format("binaryFile").load(path)).withColumn("path", F.lit(path))


def from_text(spark: SparkSession, source: str, path: str = "<string>") -> DataFrame:
    return spark.createDataFrame([(path, source, None)], FILES)


def from_rows(rows: DataFrame, path: str, source: str) -> DataFrame:
    """Files whose path and source are columns (or expressions) of a table."""
    return rows.select(F.expr(path).cast("string").alias("path"), F.expr(source).alias("source"), F.lit(None).cast("timestamp").alias("mtime"))


def spread(files: DataFrame, *keep: str) -> DataFrame:
    """files' columns keep and source, dealt evenly over as many tasks as there are shuffle partitions, or cores if they are more.

    A table of millions of small programs can be one split, which one task would parse. It is dealt by hash of all columns, so that a task that is
    run again gets the same rows, and equal paths are spread as well."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = list(dict.fromkeys([*keep, "source"]))
    return files.select(columns).repartition(n, *columns)


def stream_folder(spark: SparkSession, folder: str, pattern: str = "*.py", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of files as they are saved into folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _files(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder))


def project_root(paths: list[str]) -> str | None:
    """The nearest folder at or above all paths that holds a root mark, else their common folder."""
    if not paths:
        return None
    own = [Path(p).resolve() for p in paths]
    folders = [p if p.is_dir() else p.parent for p in own]
    common = folders[0]
    for f in folders[1:]:
        while common != f and common not in f.parents:
            if common == common.parent:
                return None
            common = common.parent
    return next((str(f) for f in (common, *common.parents) if any((f / m).exists() for m in ROOT_MARKS)), str(common))
