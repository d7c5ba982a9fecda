"""Timers and results that replace each other, against brute force and through crashes."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from verdigris.streaming import replace_log, saves, timers
from verdigris.streaming.replace_log import ReplaceLog, due

ROWS = "path string, code string, n int"


@pytest.mark.parametrize(("batches", "sizes"), [(1000, lambda i: 10), (20_000, lambda i: 1 + i * 7919 % 50), (3000, lambda i: 1000 if i % 100 == 0 else 1)])
def test_runs_stay_few_and_rows_are_rewritten_seldom(batches, sizes):
    runs, written, fed, most = [], 0, 0, 0
    for i in range(batches):
        runs.append(sizes(i))
        fed += runs[-1]
        if (start := due(runs, 8)) is not None:
            written += sum(runs[start:])
            runs[start:] = [sum(runs[start:])]
        most = max(most, len(runs))
    assert sum(runs) == fed and most <= 50 and written <= 12 * fed


def expected(batches):
    now = {}
    for keys, rows in batches:
        for k in keys:
            now[k] = sorted(r for r in rows if r[0] == k)
    return sorted(r for rows in now.values() for r in rows)


def shown(log):
    return sorted(tuple(r) for r in log.current(ROWS).collect())


def batch(rng, i):
    keys = [f"f{k}" for k in rng.sample(range(30), rng.randint(0, 6))]
    return keys, [(k, f"C{i}", j) for k in keys for j in range(rng.randint(0, 3))]


def test_the_log_shows_the_last_batch_of_every_key(spark, tmp_path):
    rng, log, done = random.Random(5), ReplaceLog(spark, str(tmp_path / "log"), fan=3), []
    assert shown(log) == [] and log.next_seq() == 0
    with pytest.raises(ValueError, match="nothing has been written"):
        log.current()
    for i in range(14):
        keys, rows = batch(rng, i)
        log.append(spark.createDataFrame([(k,) for k in [*keys, None]], "path string"), spark.createDataFrame([*rows, (f"own{i % 2}", "X", i), (None, "X", 0)], ROWS))
        done.append(([*keys, f"own{i % 2}"], [*rows, (f"own{i % 2}", "X", i)]))
        if i % 4 == 3:
            assert shown(log) == expected(done)
    assert shown(log) == expected(done) and len(log.runs()) <= 6 and log.next_seq() == 14
    # a reader that listed the runs before a merge still finds them
    before = log.current()
    log._merge()
    assert sorted(tuple(r) for r in before.collect()) == expected(done)
    log.clear()
    assert not (tmp_path / "log").exists()


def test_the_log_survives_crashes_between_and_within_its_steps(spark, tmp_path, monkeypatch):
    rng, log, done = random.Random(6), ReplaceLog(spark, str(tmp_path / "log"), fan=3), []
    frames = lambda keys, rows: (spark.createDataFrame([(k,) for k in keys], "path string"), spark.createDataFrame(rows, ROWS))
    write = ReplaceLog._write

    def dies(self, rows, first, last):
        write(self, rows, first, last)
        (tmp_path / "log" / f"run-{first:012d}-{last:012d}" / "_SUCCESS").unlink()
        raise RuntimeError("lost")

    for i in range(9):
        keys, rows = batch(rng, i)
        if i in (2, 5):  # the run is half there, and the batch comes again
            monkeypatch.setattr(ReplaceLog, "_write", dies)
            with pytest.raises(RuntimeError):
                log.append(*frames(keys, rows), i)
            assert shown(log) == expected(done)
            monkeypatch.setattr(ReplaceLog, "_write", write)
        if i == 6:  # the run is there, its merge is half done
            monkeypatch.setattr(ReplaceLog, "_merge", lambda self: dies(self, self._last(self.runs()), 0, 6))
            with pytest.raises(RuntimeError):
                log.append(*frames(keys, rows), i)
            monkeypatch.undo()
            done.append((keys, rows))
            assert shown(log) == expected(done)
            log.append(*frames(keys, rows), i)
            assert shown(log) == expected(done)
            continue
        log.append(*frames(keys, rows), i)
        done.append((keys, rows))
        assert shown(log) == expected(done)
    merged = [r for r in log.runs() if r.first < r.last]
    assert merged
    log.append(*frames(["f1"], [("f1", "late", 1)]), merged[0].first)  # a batch that is merged already changes nothing
    assert shown(log) == expected(done)


def test_a_merge_with_the_oldest_run_drops_what_nothing_needs(spark, tmp_path):
    log = ReplaceLog(spark, str(tmp_path / "log"), fan=2)
    for i in range(4):
        log.append(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "C", i)] if i < 3 else [], ROWS))
    assert shown(log) == [] and [(r.first, r.last) for r in log.runs()] == [(0, 3)]
    assert spark.read.parquet(log.runs()[0].path).count() == 0
    log.append(spark.createDataFrame([("z",)], "path string"), spark.createDataFrame([("z", "C", 1)], ROWS))
    assert shown(log) == [("z", "C", 1)]


def test_a_new_checkpoint_comes_after_what_is_there(spark, tmp_path):
    table = str(tmp_path / "t")
    assert saves.first_batch(spark, table, str(tmp_path / "c1")) == 0
    saves.replace_by_path(spark, table, spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("a", "C", 1)], ROWS), 0)
    assert saves.first_batch(spark, table, str(tmp_path / "c1")) == 0 and saves.first_batch(spark, table, str(tmp_path / "c2")) == 1


def plain_bursts(rows, quiet_us):
    out = []
    for t, p in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if out and t - out[-1][1] <= quiet_us:
            out[-1] = [out[-1][0], t, p, out[-1][3] + 1]
        else:
            out.append([t, t, p, 1])
    return sorted(map(tuple, out))


def shown_bursts(df):
    return sorted((r.s, r.e, r.path, r.saves) for r in df.select(F.unix_micros("started").alias("s"), F.unix_micros("ended").alias("e"), "path", "saves").collect())


@pytest.mark.parametrize("case", ["random", "one burst", "all apart", "ties", "few", "none"])
def test_one_timer_over_ranges_equals_a_pass_over_all(spark, case):
    rng = random.Random(3)
    rows = {
        "random": [(rng.randrange(40_000_000) * 17, rng.choice("abc")) for _ in range(3000)], "one burst": [(i * 500_000, f"p{i}") for i in range(2000)], "all apart": [(i * 500_001, f"p{i}") for i in range(2000)],
        "ties": [(i // 200 * 600_000, rng.choice(["x", "y", None])) for i in range(1500)], "few": [(5, "a"), (None, "b"), (1, None)], "none": [],
    }[case]
    df = spark.createDataFrame(rows, "us long, path string").select(F.timestamp_micros("us").alias("ts"), "path", F.lit(1).alias("range"), F.lit(2).alias("edge")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert shown_bursts(timers.debounce(df)) == plain_bursts(rows, 500_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_timer_needs_no_exchange_into_one_task(spark):
    df = spark.range(1000).select(F.timestamp_millis(F.col("id") * 400).alias("ts"), F.col("id").cast("string").alias("path"))
    plan = timers._sorted(df, "ts", "path").repartitionByRange("ts", "path").sortWithinPartitions("ts", "path")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan and "hashpartitioning" not in plan
    assert "Window" not in timers.debounce(df)._jdf.queryExecution().executedPlan().toString()


def test_a_stream_joins_the_bursts_of_its_tasks(spark, tmp_path):
    src = tmp_path / "saves"
    src.mkdir()
    times = [0.0, 0.3, 0.8, 5.0, 5.5, 6.001, 30.0, 59.0]
    for i, t in enumerate(times):  # a file each, so that tasks see parts of a burst
        (src / f"{i}.json").write_text(json.dumps({"ts": (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)).isoformat() + "Z", "path": f"p{i}"}))
    stream = spark.readStream.schema("ts timestamp, path string").json(str(src))
    q = timers.debounce(stream, late="1 second").writeStream.format("memory").queryName("joined").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {(r.path, r.saves) for r in spark.table("joined").collect()}
    assert got >= {("p2", 3), ("p4", 2), ("p5", 1)} and not got - {("p2", 3), ("p4", 2), ("p5", 1), ("p6", 1), ("p7", 1)}


@pytest.mark.parametrize("by", [None, "user"])
def test_a_timer_fires_by_the_clock_without_later_saves(spark, tmp_path, by):
    src = tmp_path / "saves"
    src.mkdir()

    def put(name, *rows):
        (tmp_path / name).write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:00:{s:02d}Z", "path": p, "user": u}) for s, p, u in rows))
        (tmp_path / name).rename(src / name)

    put("1.json", (0, "a", "u"), (1, "b", "u"), (1, "c", "v"))
    stream = spark.readStream.schema("ts timestamp, path string, user string").json(str(src))
    name = f"fired_{by}"
    q = timers.timer(stream, by, quiet_ms=300).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()

    def seen(n):
        for _ in range(240):
            if (rows := spark.table(name).collect()) and len(rows) >= n:
                break
            time.sleep(0.25)
        return sorted(tuple(r) for r in rows)

    try:
        assert seen(2 if by else 1) == ([("u", "b", 2), ("v", "c", 1)] if by else [("c", 3)])
        put("2.json", (5, "d", "u"))
        assert seen(3 if by else 2)[-1 if not by else 1] == (("u", "d", 1) if by else ("d", 1))
    finally:
        q.stop()


def test_merging_is_by_size():
    assert due([100, 1, 1], 2) == 1 and due([2, 1, 1], 2) == 0 and due([100, 1], 2) is None and due([], 2) is None and due([0, 0], 2) == 0
    assert replace_log.RUN != replace_log.GONE
