"""Stores by file: only what changed is parsed and embedded, and what is read is what a build from all files gives."""

import ast

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.operators import report, retrieval, rules
from verdigris.operators.index_store import FactStore, IndexStore, by_content, changes
from verdigris.streaming.replace_log import ReplaceLog

FILES = "path string, source string, mtime timestamp"
FIRST = {
    "base.py": ("class Base:\n    'The base.'\n", 1), "a.py": ("import base\nclass A(Base):\n    pass\nclass Both(Base):\n    pass\n", 1), "b.py": ("class B(Base):\n    pass\nclass Both(Other):\n    pass\n", 1),
    "c.py": ("def f():\n    pass\n", 1), "pkg/__init__.py": ("import base.deep\nclass P:\n    z = 1\n", 1), "pkg.py": ("class Q:\n    pass\n", 1), "bad.py": ("def (:\n", 1),
}
#: b.py loses Both, whose last writer is then a.py; pkg.py goes, c.py comes to nothing, d.py is new, bad.py is mended.
SECOND = FIRST | {"b.py": ("class B(A):\n    pass\n", 2), "c.py": ("x = 1\n", 2), "d.py": ("class D(Base):\n    pass\n", 2), "bad.py": ("class Good(Base):\n    pass\n", 2)}
del SECOND["pkg.py"]


def table(spark, files):
    return spark.createDataFrame([(p, s, t) for p, (s, t) in files.items()], "path string, source string, t long").select("path", "source", F.timestamp_seconds("t").alias("mtime"))


def content(index):
    def rows(df):
        return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)

    return {n: rows(getattr(index, n)) for n in ("chunks", "imports", "bases", "modules", "symbols")} | {"siblings": rows(index.siblings().counts())}


def test_an_update_parses_what_changed_and_equals_a_build(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    assert store.update(table(spark, FIRST)) == len(FIRST)
    assert content(store.index()) == content(retrieval.CodeIndex.build(table(spark, FIRST)))
    assert store.update(table(spark, FIRST)) == 0
    assert {(r.file, r.change) for r in store.changes(table(spark, SECOND)).collect()} == {("b.py", "changed"), ("c.py", "changed"), ("bad.py", "changed"), ("d.py", "new"), ("pkg.py", "gone")}
    # files whose times stay have another text now; parsing them would show
    poisoned = {p: (s if t == 2 else "class Poison:\n    pass\n", t) for p, (s, t) in SECOND.items()}
    assert store.update(table(spark, poisoned)) == 4
    assert content(store.index()) == content(retrieval.CodeIndex.build(table(spark, SECOND)))
    assert store.update(table(spark, {})) == 0 and store.index().chunks.count() == 0 and store.index().bases.count() == 0


@pytest.mark.parametrize("step", ["symbols", "winners", "files"])
def test_an_update_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch, step):
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.update(table(spark, FIRST))
    append = ReplaceLog.append

    def dies(self, *a, **b):
        if self.path.endswith(step) and step == "winners":
            raise RuntimeError("lost")
        append(self, *a, **b)
        if self.path.endswith(step):
            raise RuntimeError("lost")

    monkeypatch.setattr(ReplaceLog, "append", dies)
    with pytest.raises(RuntimeError):
        store.update(table(spark, SECOND))
    monkeypatch.undo()
    store.update(table(spark, SECOND))
    assert content(store.index()) == content(retrieval.CodeIndex.build(table(spark, SECOND)))


def test_manifests_differ_by_null_safe_stamps(spark):
    before, now = (spark.createDataFrame(r, "file string, stamp string") for r in ([("a", None), ("b", "1"), ("c", None), ("d", "1")], [("a", None), ("b", "1"), ("c", "2"), ("e", None)]))
    assert {(r.file, r.change) for r in changes(before, now).collect()} == {("c", "changed"), ("d", "gone"), ("e", "new")}


def test_open_mends_what_does_not_read(spark, tmp_path):
    path, df = str(tmp_path / "ix"), table(spark, FIRST)
    assert retrieval.CodeIndex.load(spark, path, df) is None
    retrieval.CodeIndex.open(spark, path, df)
    again = retrieval.CodeIndex.load(spark, path, df)
    assert again is not None and content(again) == content(retrieval.CodeIndex.build(df))
    assert retrieval.CodeIndex.load(spark, path, table(spark, SECOND)) is None
    for f in (tmp_path / "ix").rglob("*.parquet"):
        f.write_bytes(b"torn")
    for f in (tmp_path / "ix").rglob(".*.crc"):
        f.unlink()
    assert content(retrieval.CodeIndex.open(spark, path, df)) == content(retrieval.CodeIndex.build(df))
    (tmp_path / "file").write_text("in the way")
    assert content(retrieval.CodeIndex.open(spark, str(tmp_path / "file"), df)) == content(retrieval.CodeIndex.build(df))


def encoder(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [float(t.count("class")), float(len(t) % 7), 1.0])


def broken(text: pd.Series) -> pd.Series:
    raise ConnectionError("nobody is there")


def test_a_failing_encoder_leaves_structure_and_one_row(spark, tmp_path):
    df = table(spark, FIRST)
    ix = retrieval.CodeIndex.build(df, broken)
    plain = retrieval.CodeIndex.build(df)
    assert [tuple(r) for r in ix.embedding_failure().collect()] == [(ix.chunks.count(), "ConnectionError: nobody is there")]
    show = lambda i: sorted((r.for_file, r["rank"], r.symbol) for r in i.related().collect())
    assert show(ix) == show(plain) and show(plain) and plain.embedding_failure().count() == 0
    # a store tries again what failed, and embeds only what is new
    path = str(tmp_path / "ix")
    assert retrieval.CodeIndex.open(spark, path, df, broken, "m").embedding_failure().count() == 1
    good = retrieval.CodeIndex.open(spark, path, df, encoder, "m")
    assert good.embedding_failure().count() == 0 and good.vectors.count() == good.chunks.count()
    after = retrieval.CodeIndex.open(spark, path, table(spark, SECOND), lambda t: encoder(t).map(lambda v: [*v[:2], 2.0]), "m")
    fresh = {r.seq.file for r in after.vectors.collect() if r.embedding[2] == 2.0}
    assert fresh == {"b.py", "d.py", "bad.py"} and {r.seq.file for r in after.vectors.collect()} == {r.file for r in after.chunks.collect()}
    assert retrieval.CodeIndex.open(spark, path, table(spark, SECOND), encoder, "other").vectors.where("embedding[2] = 2.0").count() == 0
    short = retrieval.CodeIndex.build(df, lambda t: encoder(t)[:1] if len(t) > 1 else pd.Series([None]))
    assert short.embedding_failure().first().chunks == short.chunks.count()


SOURCES = {"a.py": ("x = a == None\ny = b == None  # noqa\n", 1), "b.py": ("import os\nx = 'a' + b\n", 1), "c.py": ("def (:\n", 1), "d.py": ("", 1)}


def findings(df):
    return sorted((r.path, r.code, r.line, r.message) for r in df.collect())


def test_stored_facts_are_reviewed_without_a_parse(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"), by_content)
    assert findings(store.review()) == [] and store.update(table(spark, SOURCES)) == 4
    assert findings(store.review()) == findings(report.review(table(spark, SOURCES))) != []
    later = SOURCES | {"b.py": ("x = open('f')\n", 1), "c.py": ("z = c != None\n", 1)}
    del later["d.py"]
    assert store.update(table(spark, later)) == 2 and findings(store.review()) == findings(report.review(table(spark, later)))
    # a rule that did not exist when the facts were stored
    rules.register_rule(rules.Rule("PY900", "every_import", "pythonic", "INFO", "Imports.", ""), lambda: F.when(rules.c("kind") == "Compare", F.array(rules.hit(F.lit("A comparison."), rules.c("line")))))
    try:
        assert {(r.path, r.line) for r in store.review(["PY900"]).collect()} == {("a.py", 1), ("c.py", 1)}
    finally:
        rules.unregister_rule("PY900")


def test_a_parsed_tree_is_reviewed_like_its_text(spark):
    source = SOURCES["a.py"][0]
    got = report.review_tree(spark, ast.parse(source), "a.py")
    from verdigris.sources.parse import syntax_facts

    assert findings(got) == findings(report.review_facts(syntax_facts(table(spark, {"a.py": (source, 1)})))) and len(findings(got)) == 2
