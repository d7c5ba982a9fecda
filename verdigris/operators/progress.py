"""Results as they are done: tables in slices, and how far a job has come."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def in_slices(rows: DataFrame, make: Callable[[DataFrame], T], size: int = 200, at_once: int = 2, key: str = "path") -> Iterator[T]:
    """make(slice) of every slice of about size rows, dealt by a hash of key, each as soon as it is done: a slow one holds up none.

    at_once slices run at a time. make runs its own jobs and gives back what its caller may hold: a slice's rows, or a table. Slices read rows anew, so
    these should be stored. An error in a slice ends the rest that has not begun."""
    n = max(1, -(-rows.count() // size))
    part = lambda i: rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(make, part(i)) for i in range(n)]
        try:
            for done in as_completed(jobs):
                yield done.result()
        finally:
            for j in jobs:
                j.cancel()


def watched(spark: SparkSession, action: Callable[[], T], report: Callable[[int, int], None], every_s: float = 0.5) -> T:
    """action(), whose tasks are counted while it runs: report(done, total) on the driver whenever a number has changed, and once at the end.

    Tasks say what they have done only through Spark, so it is Spark's own counts that are shown: what a worker would print stays on its machine."""
    group, out, over = f"verdigris-{uuid.uuid4().hex}", {}, threading.Event()
    tracker, shown = spark.sparkContext.statusTracker(), None
    seen: dict[int, tuple[int, int]] = {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "verdigris")
        try:
            out["value"] = action()
        except BaseException as e:  # handed on to the caller's thread
            out["error"] = e
        finally:
            over.set()

    def look() -> None:
        nonlocal shown
        for job in tracker.getJobIdsForGroup(group):
            for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else ()):
                if (s := tracker.getStageInfo(stage)) and (s.numCompletedTasks or info.status != "SUCCEEDED"):
                    seen[stage] = (s.numCompletedTasks, s.numTasks)
                else:  # a stage whose output was there already
                    seen.pop(stage, None)
        now = (sum(d for d, _ in seen.values()), sum(t for _, t in seen.values()))
        if now != shown and now[1]:
            shown = now
            report(*now)

    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    while not over.wait(every_s):
        look()
    worker.join()
    look()
    if "error" in out:
        raise out["error"]
    return out["value"]
