"""Trailing-edge timers: the last save of a burst, once saves rest.

One timer for all saves is a matter of order in time, not of a key. A batch is sorted by ranges of time; every task finds the bursts of its own range in one pass, and only
the first and last burst of each range, which may go on in its neighbours, are put together afterwards: two rows for each range. On a
stream every task passes on its own bursts in place of saves before they meet in the one timer's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdigris.operators.scratch import keep

#: Fixed value: how long saves must rest.
QUIET_MS = 500
BURSTS = "started timestamp, ended timestamp, path string, saves long"
MICROS = pa.timestamp("us", tz="UTC")


def bursts(batches: Iterator[pa.RecordBatch], quiet_us: int) -> Iterator[tuple[int, int, str | None, int]]:
    """(started, ended, path of the last save, saves) of (ts, path) in order of time, in microseconds."""
    open_ = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ts, path = batch.column("ts").cast(MICROS).cast(pa.int64()).to_numpy(), batch.column("path")
        begin = np.r_[0, np.flatnonzero(np.diff(ts) > quiet_us) + 1]
        end = np.r_[begin[1:], len(ts)]
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = (int(ts[a]), int(ts[b - 1]), path[b - 1].as_py(), b - a)
            if open_ is not None and own[0] - open_[1] <= quiet_us:
                open_ = (open_[0], own[1], own[2], open_[3] + own[3])
            else:
                if open_ is not None:
                    yield open_
                open_ = own
    if open_ is not None:
        yield open_


def _table(rows: list[tuple], more: list[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
    kinds = [("started", MICROS), ("ended", MICROS), ("path", pa.string()), ("saves", pa.int64()), *more]
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(c, pa.int64() if t == MICROS else t).cast(t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _sorted(saves: DataFrame, ts: str, path: str) -> DataFrame:
    return saves.select(F.col(ts).cast("timestamp").alias("ts"), F.col(path).cast("string").alias("path")).where("ts is not null")


def debounce(saves: DataFrame, ts: str = "ts", path: str = "path", quiet_ms: int = QUIET_MS, late: str | None = None) -> DataFrame:
    """(started, ended, path, saves): the last path of every burst of saves that rest at most quiet_ms from each other.

    One timer holds for all paths, so a burst is a session of the whole table and only its last save is reviewed; saves exactly
    quiet_ms apart are one burst; of saves at one time the last by path counts (null first). Saves without a time are not
    taken. A stream needs late, its watermark, and a burst stays open until later saves pass it; see timer() for one that fires by the clock.
    For independent timers see debounce_by."""
    if saves.isStreaming:
        return _streamed(saves, ts, path, quiet_ms, late)
    quiet_us, schema = quiet_ms * 1000, f"{BURSTS}, range int, edge boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, first = TaskContext.get().partitionId(), [], True
        found = bursts(batches, quiet_us)
        ahead = next(found, None)
        while ahead is not None:
            now, ahead = ahead, next(found, None)
            rows.append((*now, own, first or ahead is None))
            first = False
            if len(rows) >= 10_000 or ahead is None:
                yield _table(rows, [("range", pa.int32()), ("edge", pa.bool_())])
                rows = []

    ranged = _sorted(saves, ts, path).repartitionByRange("ts", "path").sortWithinPartitions("ts", "path")
    found = keep(ranged.mapInArrow(run, schema), "bursts")
    edges = found.where("edge").select("range", "started", "ended", "path", "saves").toArrow()  # two for each range at most
    names = ("started", "ended", "path", "saves")
    rows = sorted(zip(edges["range"].to_pylist(), *(edges[n].cast(MICROS).cast(pa.int64()).to_pylist() if n in ("started", "ended") else edges[n].to_pylist() for n in names), strict=True), key=lambda r: r[:3])
    joined = joined_borders([r[1:] for r in rows], quiet_us)
    border = saves.sparkSession.createDataFrame(pa.Table.from_batches([_table(joined)]), BURSTS) if joined else None
    inner = found.where("not edge").select(*names)
    return inner if border is None else inner.unionByName(border)


def joined_borders(rows: list[tuple[int, int, str | None, int]], quiet_us: int) -> list[tuple[int, int, str | None, int]]:
    """Bursts in order of time, those that rest at most quiet_us from each other put together."""
    out: list[tuple[int, int, str | None, int]] = []
    for r in rows:
        if out and r[0] - out[-1][1] <= quiet_us:
            out[-1] = (out[-1][0], r[1], r[2], out[-1][3] + r[3])
        else:
            out.append(r)
    return out


def _partial(saves: DataFrame, quiet_ms: int, by: str | None = None) -> DataFrame:
    """The bursts that each task sees among its own saves (of each value of by), in place of the saves."""
    names = ["ts", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*([by] if by else []), *names]
            table = pa.Table.from_batches([batch]).select(columns).sort_by([(c, "ascending") for c in columns])
            keys = table[by].to_pylist() if by else [None] * table.num_rows
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part = table.slice(a, b - a).select(names).combine_chunks().to_batches()
                rows += [(*x, *([keys[a]] if by else [])) for x in bursts(iter(part), quiet_ms * 1000)]
            if rows:
                yield _table(rows, [(by, batch.schema.field(by).type)] if by else [])

    kind = f", {by} {saves.schema[by].dataType.simpleString()}" if by else ""
    return saves.select(*([by] if by else []), *names).mapInArrow(run, BURSTS + kind)


def _streamed(saves: DataFrame, ts: str, path: str, quiet_ms: int, late: str | None) -> DataFrame:
    part = _partial(_sorted(saves, ts, path), quiet_ms)
    part = (part.withWatermark("started", late) if late else part).withColumn("_one", F.lit(1))
    # a burst's window reaches from its first save to quiet_ms beyond its last
    gap = F.make_interval(secs=((F.unix_micros("ended") - F.unix_micros("started") + F.lit(quiet_ms * 1000)) / F.lit(1_000_000)).cast("decimal(18,6)"))
    s = part.groupBy("_one", F.session_window("started", gap).alias("w")).agg(F.max_by("path", F.struct("ended", "path")).alias("path"), F.min("started").alias("first"), F.max("ended").alias("ended"), F.sum("saves").alias("saves"))
    return s.select(F.col("first").alias("started"), "ended", "path", "saves")


def debounce_by(saves: DataFrame, by: str, ts: str = "ts", path: str = "path", quiet_ms: int = QUIET_MS, late: str | None = None) -> DataFrame:
    """As debounce, with a timer for each value of by (a user, a folder); of one value's saves every task passes on sessions."""
    own = saves.withWatermark(ts, late) if late else saves
    # a session's end is exclusive and sessions that touch merge, so rests of exactly quiet_ms are inside
    s = own.groupBy(by, F.session_window(ts, f"{quiet_ms} milliseconds").alias("w")).agg(F.max_by(path, F.struct(ts, path)).alias("path"), F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("saves"))
    return s.select(by, "started", "ended", "path", "saves")


def timer(saves: DataFrame, by: str | None = None, ts: str = "ts", path: str = "path", quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of (by, path, saves): fires by the clock, quiet_ms after the last save came in, and needs no later one.

    Every new save sets the timer anew. Without by there is one timer for all saves; what reaches it from a task is the task's own bursts. State
    is kept by Spark, so a restart goes on with the timers as they stood."""
    own = saves.withColumn("_timer", F.col(by).cast("string") if by else F.lit("")).select("_timer", F.col(ts).cast("timestamp").alias("ts"), F.col(path).cast("string").alias("path")).where("ts is not null and _timer is not null")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, last, n = state.get
            state.remove()
            yield pd.DataFrame({"timer": [key[0]], "path": [last], "saves": [n]})
            return
        at, last, n = state.get if state.exists else (-(2**63), None, 0)
        for f in frames:
            for e, p, k in zip(f["ended"], f["path"], f["saves"], strict=True):
                e = int(pd.Timestamp(e).value // 1000)
                n += int(k)
                if (e, p or "") >= (at, last or ""):
                    at, last = e, p
        state.update((at, last, n))
        state.setTimeoutDuration(quiet_ms)

    fired = _partial(own, quiet_ms, "_timer").groupBy("_timer").applyInPandasWithState(step, "timer string, path string, saves long", "at long, path string, saves long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return fired.select(F.col("timer").alias(by), "path", "saves") if by else fired.select("path", "saves")
