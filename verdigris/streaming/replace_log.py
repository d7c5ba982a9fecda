"""Results that replace each other by key: a folder of runs, each written by one Spark job, merged as they grow.

A run holds the rows of the batches first..last, ``run-<first>-<last>``. It counts once Spark's committer has put its _SUCCESS file; a run that
lies within a larger one that counts is superseded. So every step is one committed job: a crash leaves a run that does not count, or two that say the same,
and never half a result.

Runs of similar size are merged once ``fan`` of them stand at the end, so their number grows with the logarithm of the batches, and a row is rewritten as
often. A merge drops what later batches of it replaced; one that takes in the oldest run also drops the marks of keys. Hence
what a read scans is at most about twice what stood in the log when the oldest run was written, plus the newer runs.

One writer at a time. Readers hold on to the runs that they listed: superseded runs are deleted one merge later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.scratch import delete, file_system

RUN, GONE = "_run", "_gone"


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    path: str
    size: int


def due(sizes: list[int], fan: int) -> int | None:
    """Where the runs begin that are to be merged, given the sizes from the oldest to the newest: those at the end of which none is more than twice
    as large as all after it together, if they are fan or more."""
    total, start = 0, len(sizes)
    for i in reversed(range(len(sizes))):
        if total and sizes[i] > 2 * total:
            break
        total += sizes[i]
        start = i
    return start if len(sizes) - start >= max(2, fan) else None


class ReplaceLog:
    """The last rows of every key. Keys are columns that are never null; rows with a null in one are not taken."""

    def __init__(self, spark: SparkSession, path: str, key: str | list[str] = "path", fan: int = 8):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.key = [key] if isinstance(key, str) else list(key)

    def _listed(self) -> list[Run]:
        where, fs = file_system(self.spark, self.path)
        if not fs.exists(where):
            return []
        out = []
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            done, _ = file_system(self.spark, f"{self.path}/{name}/_SUCCESS")
            if name.startswith("run-") and fs.exists(done):
                first, last = map(int, name[4:].split("-"))
                out.append(Run(first, last, f"{self.path}/{name}", fs.getContentSummary(s.getPath()).getLength()))
        return sorted(out, key=lambda r: (r.first, -r.last))

    def runs(self) -> list[Run]:
        """The runs that count, from the oldest to the newest."""
        out: list[Run] = []
        for r in self._listed():
            if not out or r.last > out[-1].last:
                out.append(r)
        return out

    def next_seq(self) -> int:
        runs = self.runs()
        return runs[-1].last + 1 if runs else 0

    def append(self, keys: DataFrame, rows: DataFrame, seq: int | None = None) -> int:
        """Replaces the rows of keys, and of the keys in rows, by rows (key columns and others); keys without rows have none from now on.

        Rows are written where they are computed, with one mark more for each key: nothing is joined or shuffled but the keys. seq is the batch's
        number, by default the next one. A batch that is run again overwrites its own run, or does nothing if that is merged already."""
        runs = self.runs()
        seq = (runs[-1].last + 1 if runs else 0) if seq is None else seq
        if any(r.first <= seq <= r.last and r.first < r.last for r in runs):
            return seq
        whole = " and ".join(f"{k} is not null" for k in self.key)
        marks = keys.select(self.key).where(whole).distinct().withColumn(GONE, F.lit(True))
        marked = rows.where(whole).withColumn(GONE, F.lit(False)).unionByName(marks, allowMissingColumns=True)
        self._write(marked.withColumn(RUN, F.lit(seq).cast("long")).select(*rows.columns, RUN, GONE), seq, seq)
        self._merge()
        return seq

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/run-{first:012d}-{last:012d}")

    def _merge(self) -> None:
        runs = self.runs()
        start = due([r.size for r in runs], self.fan)
        if start is None:
            return
        counted = {r.path for r in runs}
        for old in self._listed():
            if old.path not in counted:
                delete(self.spark, old.path)
        part = runs[start:]
        rows = self._last(part)
        self._write(rows.where(~F.col(GONE)) if start == 0 else rows, part[0].first, part[-1].last)

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(runs[-1].path).schema).parquet(*[r.path for r in runs])

    def _last(self, runs: list[Run]) -> DataFrame:
        """Each key's rows in the newest of runs that has it. The oldest run, most often the largest, is only filtered by the keys of the others."""
        if len(runs) == 1:
            return self._read(runs)
        newer = self._read(runs[1:])
        last = newer.groupBy(*self.key).agg(F.max(RUN).alias(RUN))
        kept = self._read(runs[:1]).join(last.select(self.key), self.key, "left_anti")
        return kept.unionByName(newer.join(last, [*self.key, RUN], "left_semi"))

    def current(self, schema: str | None = None) -> DataFrame:
        """The rows of every key as its last batch left them. A log without batches has schema, if it is given."""
        runs = self.runs()
        if not runs:
            if schema is None:
                raise ValueError(f"nothing has been written to {self.path}")
            return self.spark.createDataFrame([], schema)
        return self._last(runs).where(~F.col(GONE)).drop(RUN, GONE)

    def clear(self) -> None:
        delete(self.spark, self.path)
