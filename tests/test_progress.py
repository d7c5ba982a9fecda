"""Answers that are asked for once, slices as they are done, and progress that the driver sees."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from verdigris.operators import model_review, progress


class Journaled:
    """A model that writes down what it is asked, in files, as calls come from workers."""

    def __init__(self, folder, fails=()):
        self.folder, self.fails = str(folder), fails

    def __call__(self, messages):
        import pathlib
        import uuid

        text = messages[1]["content"]
        if any(f in text for f in self.fails):
            raise OSError("down")
        (pathlib.Path(self.folder) / uuid.uuid4().hex).write_text(text)
        return json.dumps({"choices": [{"message": {"content": "{}"}}]})

    def asked(self):
        import pathlib

        return sorted(p.read_text() for p in pathlib.Path(self.folder).iterdir())


def test_nothing_is_asked_twice(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model, journal, seen = Journaled(tmp_path / "calls", fails=("p7",)), str(tmp_path / "journal"), []
    rows = spark.createDataFrame([(f"f{i}", "logic", f"p{i % 15}") for i in range(20)], "path string, focus string, prompt string")
    ask = lambda m, df: {r.path: (r.response is not None, r.error) for r in model_review.ask_once(df, model_review.Client(m, tries=1), journal, wave=4, progress=lambda *x: seen.append(x)).collect()}
    got = ask(model, rows.where("path <> 'f3'"))
    assert got == {f"f{i}": (i % 15 != 7, "OSError: down" if i % 15 == 7 else None) for i in range(20) if i != 3}
    assert model.asked() == sorted(f"p{i}" for i in range(15) if i != 7) and seen[-1] == (15, 15) and len(seen) > 1 and all(a[0] <= b[0] for a, b in zip(seen, seen[1:], strict=False))
    # a later run asks what failed and what is new
    model.fails = ()
    assert ask(model, rows.unionByName(spark.createDataFrame([("g", "logic", "new")], rows.schema)))["f7"] == (True, None)
    assert model.asked() == sorted([*(f"p{i}" for i in range(15)), "new"])
    assert ask(Journaled(tmp_path / "none", fails=("",)), rows) == {f"f{i}": (True, None) for i in range(20)} and seen[-1] == (2, 2)


def test_a_run_that_breaks_off_keeps_its_waves(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    model, journal, real, waves = Journaled(tmp_path / "calls"), str(tmp_path / "journal"), model_review.ask, []
    rows = spark.createDataFrame([(f"f{i}", "logic", f"p{i}") for i in range(24)], "path string, focus string, prompt string")

    def dies(*a, **b):
        waves.append(1)
        if len(waves) == 3:
            raise RuntimeError("lost")
        return real(*a, **b)

    monkeypatch.setattr(model_review, "ask", dies)
    with pytest.raises(RuntimeError):
        model_review.ask_once(rows, model_review.Client(model), journal, wave=6)
    before = model.asked()
    assert 0 < len(before) < 24
    model_review.ask_once(rows, model_review.Client(model), journal, wave=6).collect()
    assert model.asked() == sorted(f"p{i}" for i in range(24))


def test_slices_come_as_they_are_done(spark):
    rows, slow = spark.range(400).select(F.col("id").cast("string").alias("path")), threading.Event()
    first = []

    def make(part):
        got = {r.path for r in part.collect()}
        if not first:
            first.append(got)
            slow.wait(30)  # the first slice to begin is held up
        return got

    out = []
    for got in progress.in_slices(rows, make, size=100, at_once=2):
        out.append(got)
        if len(out) == 3:
            slow.set()
    assert len(out) == 4 and out[-1] == first[0] and set().union(*out) == {str(i) for i in range(400)} and sum(map(len, out)) == 400
    with pytest.raises(ZeroDivisionError):
        list(progress.in_slices(rows, lambda part: 1 / 0, size=100))
    assert list(progress.in_slices(rows.where("false"), lambda part: part.count())) == [0]


def test_the_driver_sees_how_far_a_job_has_come(spark):
    seen = []

    def wait(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    assert progress.watched(spark, lambda: spark.range(0, 16, numPartitions=8).mapInArrow(wait, "id long").count(), lambda d, t: seen.append((d, t)), every_s=0.05) == 16
    assert len(seen) > 2 and seen[-1][0] == seen[-1][1] >= 8 and all(a[0] <= b[0] for a, b in zip(seen, seen[1:], strict=False))
    with pytest.raises(KeyError):
        progress.watched(spark, lambda: {}["no"], lambda d, t: None)


def test_waves_that_are_answered_at_once_are_joined(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.format_string("f%d", "id").alias("path"), F.lit("logic").alias("focus"), F.format_string("p%d", "id").alias("prompt"))
    model, asked, real = model_review.Client(lambda m: "{}"), [], model_review.ask

    def counted(*a, **b):
        asked.append(1)
        return real(*a, **b)

    monkeypatch.setattr(model_review, "ask", counted)
    seen = []
    got = model_review.ask_once(rows, model, str(tmp_path / "quick"), wave=10, progress=lambda *x: seen.append(x))
    assert got.where("response is not null").count() == 400 and len(asked) <= 6 and seen[-1] == (400, 400)
    # a slow model has its waves by themselves
    monkeypatch.setattr(model_review, "QUICK_S", 0)
    asked.clear()
    model_review.ask_once(rows.limit(40), model, str(tmp_path / "slow"), wave=10)
    assert len(asked) == 4
