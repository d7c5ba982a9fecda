"""What the operators of this folder share: shared-folder tables, Arrow plumbing and column hygiene.

Conventions, the same for every operator:

* a null text counts as the empty text unless the operator's docstring says otherwise;
* every row is a document of its own, so repeated rows give repeated results;
* input columns that the operator does not name are either dropped or passed on untouched, and a result
  column replaces an input column of the same name;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own if everything
    runs on this machine, and an error on a cluster, whose executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault("base", f"/tmp/verdigris-shared/{uuid.uuid4().hex}")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; the folder goes when the session's process ends."""
    path = f"{shared_dir(spark)}/verdigris-{name}-{uuid.uuid4().hex}"
    _OWN[path] = path
    return path


def materialize(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage.

    Unlike a checkpoint the table is columnar and compressed; unlike a local one it outlives executors.
    The files go when the session's process ends, or earlier through :func:`discard`.

    Rows of megabytes need group_bytes, the size of a row group: a task that writes or reads a table holds a whole row group, or
    4,096 rows of one, and by default the writer does not look at a group's size before its 100th row."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df itself if its rows come straight from files, so that a task that is run again reads the same; else as a table."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    plain = all(any(op in line for op in ("Scan parquet", "Project", "Filter", "ColumnarToRow")) for line in plan.splitlines() if line.strip())
    return df if plain else materialize(df, name)


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables made by materialize() that no later plan reads."""
    for t in tables:
        if t is not None and (path := getattr(t, "_verdigris_path", None)) and _OWN.pop(path, None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _cleanup() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for path in [p for p in _OWN if p != "base"]:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                _delete(spark, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns that an operator needs, so that clashing names cannot matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column; Spark's names know no case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def release() -> None:
    """Gives memory that Python no longer uses back to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such calls
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays over 1 MB are mapped, and so unmapped when they go
        libc.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
                release()

    return df.mapInArrow(run, schema)


def small_slices(batch: pa.RecordBatch, most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about most_bytes of text; a longer text is a slice of its own, never cut."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    most_bytes = sum(sizes) / max(1, -(-sum(sizes) // most_bytes))  # even slices
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
