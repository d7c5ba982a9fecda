"""Sources, reports, retrieval, model review, analytics, streaming and the command line."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris import cli
from verdigris.functions import text as T
from verdigris.operators import analytics, endpoint, model_review, report, retrieval
from verdigris.sources import files
from verdigris.streaming import saves

FILES = "path string, source string, mtime timestamp"


def put(folder, **texts):
    for name, text in texts.items():
        p = folder / (name.replace("__", "/", 1) + ".py")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(folder)


def table(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/", 1) + ".py", v, None) for k, v in texts.items()], FILES)


def test_folder_scan_is_recursive_and_relative(spark, tmp_path):
    put(tmp_path, a="x = 1\n", sub__b="y = 2\n")
    (tmp_path / "readme.md").write_text("no")
    got = files.read_folder(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.path, r.source) for r in got] == [("a.py", "x = 1\n"), ("sub/b.py", "y = 2\n")] and got[0].mtime is not None
    assert files.read_file(spark, str(tmp_path / "a.py")).first().source == "x = 1\n"
    (tmp_path / "latin.py").write_bytes(b"x = '\xe9'\n")
    (tmp_path / "a b+c%20.py").write_text("z = 1\n")
    got = {r.path: r.source for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["latin.py"] is None and got["a b+c%20.py"] == "z = 1\n"
    assert [r.path for r in report.errors(files.read_folder(spark, str(tmp_path))).collect()] == ["latin.py"]
    rows = files.from_rows(spark.range(2), "concat('f', id)", "concat('x = ', id)").orderBy("path").collect()
    assert [(r.path, r.source) for r in rows] == [("f0", "x = 0"), ("f1", "x = 1")]


def test_project_root(tmp_path):
    (tmp_path / "p" / "pkg" / "a").mkdir(parents=True)
    (tmp_path / "p" / "setup.cfg").write_text("")
    assert files.project_root([str(tmp_path / "p" / "pkg" / "a"), str(tmp_path / "p" / "pkg")]) == str(tmp_path / "p")
    assert files.project_root([]) is None


def test_reports(spark, tmp_path):
    df = table(spark, clean="x = 1\n", dirty="import os\nx = y == None\n")
    found = report.review(df)
    row = report.summary(df, found).first()
    assert row.asDict() == {"reviewed": 2, "clean": 1, "dirty": 1, "warnings": 0, "suggestions": 1, "info": 0}
    assert "Info" not in report.summary_text(row) and "Suggestions   : 1" in report.summary_text(row)
    shown = {r.path: r.rendered for r in report.text_lines(df, found).collect()}
    assert shown["clean.py"] == "Check complete, good code!\n"
    assert shown["dirty.py"] == "PYTHONIC:\n\n  PY007  SUGGESTION  L2  dirty.py:2\n      Use 'is None'/'is not None' instead of '== None'/'!= None'.\n      2 | x = y == None\n\n"
    got = {r.path: json.loads(r.json) for r in report.json_reports(df, found).collect()}
    assert got["clean.py"] == {"path": "clean.py", "issues": []}
    assert got["dirty.py"]["issues"] == [{"code": "PY007", "category": "pythonic", "severity": "SUGGESTION", "message": "Use 'is None'/'is not None' instead of '== None'/'!= None'.", "line": 2, "column": 0, "end_line": 0}]
    assert [(r.path, r.n) for r in report.clean_first(df, found).collect()] == [("clean.py", 0), ("dirty.py", 1)]
    report.write_text(found, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()][0] == "── dirty.py ──"
    report.write_json(df, found, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    d = report.diagnostics(found).first()
    assert (d.line, d.to_column, d.level, d.code) == (1, 1000, "Hint", "PY007")
    assert report.links(found, editor=True).first().uri == "vscode://filedirty.py:2"


def test_noqa_forms(spark):
    lines = ["# noqa", "#noqa: PY001,DES003", "# noqa: PY001 , PY002 - why", "# noqa: foo", "# noqa: PY007abc", "# NOQA", "# noqax", "a # noqa: PY007,foo # noqa: PY001"]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "path int, source string")
    got = {}
    for r in T.noqa_rows(df).collect():
        got.setdefault(r.path, set()).add(r.code)
    assert got == {0: {None}, 1: {"PY001", "DES003"}, 2: {"PY001", "PY002"}, 3: {None}, 4: {None}, 7: {"PY007"}}


def test_lines_end_as_in_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.lines for r in df.select("i", T.source_lines(F.col("t")).alias("lines")).collect()}
    assert got == {i: t.splitlines() for i, t in enumerate(texts)}


ANSWERS = {
    "plain": ('{"suggestions": [{"line": 2, "message": " m ", "severity": "warning"}]}', [(2, "m", "WARNING")]),
    "empty": ('{"suggestions": []}', []),
    "fenced": ('```json\n{"suggestions": [{"line": 1, "message": "m"},]}\n```', [(1, "m", "SUGGESTION")]),
    "prose": ('Sure: {"suggestions": [{"line": 1, "message": "m", "severity": "odd"}]} Bye', [(1, "m", "SUGGESTION")]),
    "cut": ('{"suggestions": [{"line": 1, "message": "a \\"q\\"", "severity": "info"}, {"line": 3, "message": "b"}, {"line": 4, "mess', [(1, 'a "q"', "INFO"), (3, "b", "SUGGESTION")]),
    "none": ("no json", []),
    "array": ('[{"line": 1, "message": "m"}]', None),
    "scalar": ('{"suggestions": 7}', []),
    "types": ('{"suggestions": [{"line": "7", "message": "m"}, 3, {"line": 7.0, "message": "m"}, {"line": true, "message": "t"}, {"line": 2, "message": 5}]}', [(1, "t", "SUGGESTION")]),
    "many": (json.dumps({"suggestions": [{"line": i, "message": "m"} for i in range(1, 20)]}), [(i, "m", "SUGGESTION") for i in range(1, 6)]),
    "first five count": (json.dumps({"suggestions": [{"line": i, "message": ""} for i in range(1, 6)] + [{"line": 6, "message": "m"}]}), []),
}


def test_answers_are_parsed_tolerantly(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in ANSWERS.items()], "name string, content string")
    got = {r.name: [(x.line, x.message, x.severity) for x in r.suggestions] for r in T.parse_suggestions(df).collect()}
    for name, (_, want) in ANSWERS.items():
        if want is not None:
            assert got[name] == want, name


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])], "k string, v array<double>")
    assert {r.k: r.centroid for r in T.centroid(df, "k", "v").collect()} == {"a": [0.5, 0.5], "b": [0.0, 0.0]}
    pairs = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 9) for r in pairs.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(T.cosine(F.col("a"), F.col("b"))).collect()


PROJECT = {
    "base": "class Base:\n    'The base.'\n    def run(self):\n        pass\n",
    "a": "import base\nfrom base import Base\nclass A(Base):\n    pass\n",
    "b": "from base import Base\nimport base\nclass B(Base):\n    pass\n",
    "c": "import base, json\nclass C(Base):\n    pass\n",
    "solo": "def helper(x, *, y):\n    '   '\n    return x\n",
    "pkg____init__": "import base.sub.deep\nclass P:\n    z = 1\n",
    "bare": "import base\n",
    "broken": "def broken(:\n",
}


def encoder(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [float(t.count("class")), float(len(t) % 7), 1.0])


def test_index_graph_and_siblings(spark):
    ix = retrieval.CodeIndex.build(table(spark, **PROJECT))
    assert {r.file for r in ix.chunks.collect()} == {"base.py", "a.py", "b.py", "c.py", "solo.py", "pkg/__init__.py"}
    assert {(r.module, r.file) for r in ix.modules.collect()} >= {("pkg", "pkg/__init__.py"), ("base", "base.py")}
    assert {(r.file, r.target) for r in ix.imported_files().collect()} == {(f, "base.py") for f in ("a.py", "b.py", "c.py", "pkg/__init__.py")}
    assert {(r.file, r.sibling) for r in ix.siblings().pairs(ix.chunks).collect()} == {(x, y) for x in ("a.py", "b.py", "c.py") for y in ("a.py", "b.py", "c.py") if x != y}
    assert {r.file: r.matches for r in ix.siblings_match().collect()} == {"a.py": True, "b.py": True, "c.py": False, "base.py": False, "solo.py": False, "pkg/__init__.py": False}
    solo = ix.chunks.where("file = 'solo.py'").first()
    assert (solo.signature, solo.docstring, solo.body) == ("def helper(x, *, y)", "", "")


def test_last_definition_of_a_name_wins(spark):
    ix = retrieval.CodeIndex.build(table(spark, a="class X(P):\n    pass\nclass X(Q):\n    pass\n", b="class X(R):\n    pass\n"))
    assert {(r.class_name, r.base) for r in ix.bases.collect()} == {("X", "R")}
    assert ix.symbols.where("symbol = 'X'").first().file == "b.py"


def test_related_is_structural_first_then_similar(spark):
    ix = retrieval.CodeIndex.build(table(spark, **PROJECT), encoder)
    got = {}
    for r in ix.related(3).orderBy("rank").collect():
        got.setdefault(r.for_file, []).append(r.symbol)
    assert all(len(v) <= 3 and len(set(v)) == len(v) for v in got.values())
    assert got["a.py"][0] == "Base" and "A" not in got["a.py"] and len(got["a.py"]) == 3
    plain = retrieval.CodeIndex.build(table(spark, **PROJECT))
    assert {r.for_file for r in plain.related().collect()} == {"a.py", "b.py", "c.py", "pkg/__init__.py"}
    text = {r.for_file: r.related for r in retrieval.render_related(plain.related()).collect()}
    assert text["a.py"] == "  base.py: class Base — class Base\n      The base."
    # top-k against brute force
    chunks = ix.chunks.join(ix.vectors, "seq").collect()
    own = {}
    for c in chunks:
        own.setdefault(c.file, []).append(c.embedding)
    q = [sum(x) / len(own["solo.py"]) for x in zip(*own["solo.py"], strict=True)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = [c.symbol for c in sorted((c for c in chunks if c.file != "solo.py"), key=lambda c: (round(cos(q, c.embedding), 12), c.seq.file, c.seq.ord), reverse=True)]
    assert got["solo.py"] == want[:3]


def client(answer):
    return model_review.Client(lambda messages: json.dumps({"choices": [{"message": {"content": answer(messages)}}]}), pause_s=0)


LONG = "import os\n'doc'\n" + "x = y == None\n" + "z = 1\n" * 12


def test_model_review_filters_lines_and_keeps_static_findings(spark):
    df = spark.createDataFrame([("long.py", LONG, None), ("short.py", "x = y == None\n", None)], FILES)
    answer = lambda m: json.dumps({"suggestions": [{"line": n, "message": f"at {n}"} for n in (1, 2, 3, 99, 4)]})
    found, failed = model_review.review_with_model(df, client(answer))
    got = sorted((r.path, r.code, r.line) for r in found.collect())
    assert got == [("long.py", "LLM001", 3), ("long.py", "LLM001", 4), ("long.py", "PY007", 3), ("short.py", "PY007", 1)] and failed.count() == 0

    def broken(messages):
        raise OSError("down")

    found, failed = model_review.review_with_model(df, model_review.Client(broken, tries=2, pause_s=0))
    assert sorted((r.path, r.code) for r in found.collect()) == [("long.py", "PY007"), ("short.py", "PY007")]
    assert [(r.path, r.focus, r.error) for r in failed.orderBy("focus").collect()] == [("long.py", f, "OSError: down") for f in ("design", "logic")]


def test_suppressions_hold_for_model_findings_unless_told_otherwise(spark):
    df = spark.createDataFrame([("a.py", "z = 1\n" * 12 + "w = 2  # noqa: LLM001\n", None)], FILES)
    answer = lambda m: json.dumps({"suggestions": [{"line": 13, "message": "m"}, {"line": 2, "message": "n"}]})
    lines = lambda **more: sorted(r.line for r in model_review.review_with_model(df, client(answer), focuses=("logic",), **more)[0].collect())
    assert lines() == [2] and lines(suppress_model=False) == [2, 13]


def test_consistency_only_where_siblings_differ(spark):
    pad = "z = 1\n" * 10
    df = table(spark, **{k: v + pad for k, v in PROJECT.items() if k != "broken"})
    seen = lambda m: json.dumps({"suggestions": [{"line": 3, "message": "departs"}] if "Compare the file" in m[1]["content"] else []})
    found, _ = model_review.review_with_model(df, client(seen), retrieval.CodeIndex.build(df))
    assert {r.path for r in found.where("code = 'LLM002'").collect()} == {"c.py", "pkg/__init__.py"}


def test_prompts_show_what_they_should(spark):
    df = spark.createDataFrame([("a.py", "import os\n\ndef f():\n    'doc'\n    return 1\n", None)], FILES)
    views = model_review.source_views(df)
    v = views.first()
    assert v.outline == "def f (line 3)" and v.hidden == [1, 4] and v.valid == [1, 3, 4, 5]
    related = spark.createDataFrame([("a.py", "RELATED")], "for_file string, related string")
    p = model_review.prompts(views, report.review(df), related, ("logic",)).first().prompt
    assert "import os" not in p and "'doc'" not in p and "return 1" in p and "RELATED" in p and all(r in p for r in model_review.RELATED)
    with pytest.raises(ValueError, match="focus"):
        model_review.prompts(views, focuses=("style",))
    assert model_review.outline("def (") == "(unparseable)" and model_review.outline("x = 1") == "(no top-level definitions)"


def test_analytics_hold_no_source(spark, tmp_path):
    df = table(spark, clean="x = 1\n", dirty="SECRET = y == None\n")
    events = analytics.review_events(df, report.review(df), "s1", "static")
    analytics.append_events(events, str(tmp_path / "e"))
    back = spark.read.json(str(tmp_path / "e"))
    assert back.count() == 2 and "date" in back.columns and "SECRET" not in str(back.collect())
    assert {r.origin: r.n for r in analytics.origin_split(report.review(df)).collect()} == {"static": 1}
    assert analytics.target_histogram(events).first().n == 2


def test_debounce_takes_the_last_save_of_a_burst(spark):
    rows = [(0, "a"), (400, "b"), (900, "c"), (1401, "d"), (5000, "e")]
    df = spark.createDataFrame(rows, "ms long, path string").select(F.timestamp_millis("ms").alias("ts"), "path")
    assert [(r.path, r.saves) for r in saves.debounce(df).orderBy("ended").collect()] == [("c", 3), ("d", 1), ("e", 1)]


def test_stream_replaces_results_by_path(spark, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    put(src, a="x = y == None\n", b="def broken(:\n", c="z = open('f')\n")
    failed = []
    run = lambda: saves.review_stream(files.stream_folder(spark, str(src)), out, check, lambda e, i: failed.extend(r.path for r in e.collect()), available_now=True).awaitTermination(120)
    run()
    first = {(r.path.rsplit("/", 1)[1], r.code) for r in saves.read_current(spark, out).collect()}
    assert first == {("a.py", "PY007"), ("c.py", "PY003")} and [f.rsplit("/", 1)[1] for f in failed] == ["b.py"]
    time.sleep(1.1)
    (src / "a.py").unlink()
    put(src, d="p = 'x' + q\n")
    (src / "c.py").unlink()
    put(src, c="z = 1\n")
    import os

    os.utime(src / "c.py", (time.time() + 5, time.time() + 5))
    run()
    second = {(r.path.rsplit("/", 1)[1], r.code) for r in saves.read_current(spark, out).collect()}
    assert ("d.py", "PY002") in second and ("a.py", "PY007") in second
    saves.clear(spark, out)
    assert not (tmp_path / "out").exists()


def test_debounce_runs_as_a_stream(spark, tmp_path):
    src = tmp_path / "saves"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:00:{s:02d}Z", "path": p, "user": "u"}) for s, p in [(0, "a"), (0, "b"), (30, "c"), (59, "d")]))
    stream = spark.readStream.schema("ts timestamp, path string, user string").json(str(src))
    q = saves.debounce(stream, late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {(r.path, r.saves) for r in spark.table("bursts").collect()} >= {("b", 2)}


class Server:
    """An endpoint on this machine: answers come from a function of (path, body), which may raise."""

    def __init__(self, answer):
        import http.server
        import threading

        calls = self.calls = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                calls.append((body, self.headers.get("Authorization")))
                code, text = answer(body)
                self.send_response(code)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("localhost", 0), Handler)
        self.url = f"http://localhost:{self.server.server_port}/v1"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_endpoints_are_resolved_retried_and_checked(monkeypatch):
    for name in ("URL", "KEY", "MODEL"):
        monkeypatch.delenv(f"VERDIGRIS_LLM_{name}", raising=False)
    assert endpoint.Chat.resolve().url == endpoint.LOCAL_CHAT and endpoint.Chat.resolve().local
    assert endpoint.Chat.resolve(key="k").url == endpoint.REMOTE_CHAT and not endpoint.Chat.resolve(key="k").local
    monkeypatch.setenv("VERDIGRIS_LLM_URL", "http://localhost:1/x")
    tried = []
    monkeypatch.setattr(endpoint.time, "sleep", tried.append)
    assert "cannot be reached" in endpoint.Chat.resolve().check_runtime() and tried == [2.0, 4.0]  # a local one may be starting
    assert endpoint.Chat.resolve(key="k").check_runtime() and len(tried) == 2
    good = Server(lambda body: (200, json.dumps({"choices": [{"message": {"content": "hi"}}]})))
    assert endpoint.Chat.resolve(good.url, "secret", "m").check_runtime() is None
    assert good.calls[0][0]["model"] == "m" and good.calls[0][0]["max_tokens"] == 1 and good.calls[0][1] == "Bearer secret"
    for code, text in ((500, "broken"), (200, "no json")):
        bad = Server(lambda body, c=code, t=text: (c, t))
        assert endpoint.Chat.resolve(bad.url).check_runtime() and len(bad.calls) == 1  # it is there: not asked again


def test_embeddings_come_in_both_shapes_and_report_progress(spark):
    one = Server(lambda body: (200, json.dumps({"embeddings": [[float(len(t)), 1.0] for t in body["input"]]})))
    two = Server(lambda body: (200, json.dumps({"data": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]]})))
    seen = []
    for s in (one, two):
        assert endpoint.Embedder(s.url, progress=lambda *x: seen.append(x))(pd.Series(["a", "bb"])).tolist() == [[1.0, 1.0], [2.0, 1.0]]
    assert seen == [(2, 2), (2, 2)] and len(one.calls) == 1 and one.calls[0][0]["input"] == ["a", "bb"]
    assert endpoint.Embedder(one.url)(pd.Series([], dtype=object)).tolist() == []
    with pytest.raises(OSError):
        endpoint.Embedder(Server(lambda body: (200, "{}")).url)(pd.Series(["a"]))
    ix = retrieval.CodeIndex.build(table(spark, **PROJECT), endpoint.Embedder(one.url))
    assert all(len(r.embedding) == 2 for r in ix.vectors.collect())


def test_command_line_asks_the_model(spark, tmp_path, capsys, monkeypatch):
    chat = Server(lambda body: (200, json.dumps({"choices": [{"message": {"content": json.dumps({"suggestions": [{"line": 3, "message": "Name it better."}]})}}]})))
    embed = Server(lambda body: (200, json.dumps({"embeddings": [[1.0, float(len(t))] for t in body["input"]]})))
    monkeypatch.setenv("VERDIGRIS_LLM_URL", chat.url)
    monkeypatch.setenv("VERDIGRIS_EMBED_URL", embed.url)
    root = put(tmp_path, a=LONG, clean="x = 1\n")
    assert cli.main(["-r", root, "--llm", "--rag-embed", "--workers", "2", "--export", str(tmp_path / "out.txt"), "--yes"]) == 0
    out = capsys.readouterr().out
    assert "Name it better." in out and out.index("clean.py") < out.index("a.py ──") and "\033]8" not in out
    assert "LLM001" in (tmp_path / "out.txt").read_text() and (tmp_path / ".verdigris" / "index" / "v2" / "files").is_dir()
    monkeypatch.setenv("VERDIGRIS_LLM_URL", "http://localhost:1/x")
    monkeypatch.setattr(endpoint, "PAUSE_S", 0)
    monkeypatch.setattr(endpoint.time, "sleep", lambda s: None)
    assert cli.main(["-r", root, "--llm"]) == 0  # rules alone
    assert "no model review" in capsys.readouterr().err
    assert report.hyperlink("file:///a", "a") == "\033]8;;file:///a\033\\a\033]8;;\033\\"


def test_places_are_those_of_a_global_order(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 as a").repartition(5)
    assert [r.id for r in report.numbered(rows, "n", "a", "id").orderBy("n").collect()] == sorted(range(500), key=lambda i: (i % 7, i))
    assert report.numbered(rows.where("false"), "n", "a").collect() == []


def test_siblings_match_equals_the_pairs(spark):
    texts = {f"f{i}": f"import {'json' if i % 3 else 'os'}\nclass C{i}(Exception):\n    pass\n" + ("class C1(Exception):\n    pass\n" if i == 5 else "") for i in range(9)} | {"solo": "class S(Other):\n    pass\n"}
    ix = retrieval.CodeIndex.build(table(spark, **texts))
    sig = {r.file: (tuple(r.modules), tuple(r.bases)) for r in ix.signatures().collect()}
    want = {f: False for f in sig}
    pairs = ix.siblings().pairs(ix.chunks).collect()
    for r in pairs:
        want[r.file] |= sig[r.file] == sig[r.sibling]
    assert {r.file: r.matches for r in ix.siblings_match().collect()} == want and len(set(want.values())) == 2
    # every file has one base here, so that siblings through it are all siblings
    number = {f: sum(r.file == f for r in pairs) for f in want}
    assert {r.file: r.siblings for r in ix.siblings().counts().collect()} == {f: n for f, n in number.items() if n}


def test_siblings_of_a_common_base_are_no_pairs(spark):
    n = 400
    files = spark.range(n).select(F.format_string("f%d.py", "id").alias("path"), F.format_string("class C%d(Exception):\n    pass\nclass D%d(Base%d, Exception):\n    pass\n", "id", "id", F.col("id") % 7).alias("source"), F.lit(None).cast("timestamp").alias("mtime"))
    s = retrieval.CodeIndex.build(files).siblings()
    sizes = [d.count() for d in (s.members, s.classes, s.known)]
    assert max(sizes) <= 3 * n
    got = {(r.file, r.base): r.siblings for r in s.counts().collect()}
    assert all(got[f"f{i}.py", "Exception"] == n - 1 and got[f"f{i}.py", f"Base{i % 7}"] == len(range(i % 7, n, 7)) - 1 for i in range(n))
    assert s.pairs(spark.createDataFrame([("f3.py",)], "file string")).count() == n - 1


def test_command_line(spark, tmp_path, capsys):
    root = put(tmp_path, a="x = 1\n", sub__b="x = y == None\n")
    assert cli.main(["-r", root]) == 0
    out = capsys.readouterr().out
    assert out.index("a.py") < out.index("sub/b.py") and "Files reviewed : 2" in out and "2 |" not in out
    assert cli.main(["--json", str(tmp_path / "a.py")]) == 0
    assert json.loads(capsys.readouterr().out)["issues"] == []
    put(tmp_path, bad="def broken(:\n")
    assert cli.main(["-r", root]) == 1 and "SyntaxError" in capsys.readouterr().err
    assert cli.main([]) == 2 and cli.main([str(tmp_path / "missing.py")]) == 1
    (tmp_path / "empty").mkdir()
    assert cli.main(["-r", str(tmp_path / "empty")]) == 0


def test_nearest_is_one_plan_for_any_number_of_queries(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(300, 5)), 2)
    v[50:60] = v[40:50]
    rows = [(i, f"o{i % 40}", f"n{i % 90}", v[i].tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "at long, owner string, name string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", f"o{i % 40}", v[i].tolist()) for i in range(0, 300, 3)], "query string, owner string, q array<double>")
    seen = spark.createDataFrame([(f"q{i}", f"n{j % 90}") for i in range(0, 300, 9) for j in range(i, i + 7)], "query string, name string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    known, want = {(r.query, r.name) for r in seen.collect()}, {}
    for i in range(0, 300, 3):
        names, best = set(), []
        for j in sorted(range(300), key=lambda j: (round(float(unit[i] @ unit[j]), 9), j), reverse=True):
            if rows[j][1] != f"o{i % 40}" and rows[j][2] not in names and (f"q{i}", rows[j][2]) not in known:
                names.add(rows[j][2])
                best.append(j)
        want[f"q{i}"] = best[:4]
    for block in (7, 2000):
        found = retrieval.nearest(queries, vectors, 4, seen, block)
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.at)
        assert got == want
    many = retrieval.nearest(spark.range(100_000).selectExpr("id as query", "'x' as owner", "array(1.0D, 2.0D) as q"), vectors, 4)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Union" not in plan
    with pytest.raises(Exception, match="different lengths"):
        many.collect()


def test_nearest_ranks_by_rounded_similarity(spark, tmp_path):
    from verdigris.plans import table_queries

    # cosines to vector 0 are 1 - 5e-9 and less: the same to six decimals, so that the larger id is the nearer one
    rows = [(i, [1.0, i * 1e-4]) for i in range(8)] + [(i, [0.0, 1.0]) for i in (8, 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.rank, r.vec_id, r.sim) for r in table_queries.topk_cosine(spark, str(tmp_path)).collect()}
    assert got == {(n + 1, 7 - n, 1.0) for n in range(5)}
    vectors = spark.createDataFrame([(i, i, str(i), v) for i, v in rows], "at long, owner long, name string, embedding array<double>")
    query = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query long, owner long, q array<double>")
    assert [r.at for r in retrieval.nearest(query, vectors, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_all_siblings_of_a_file_are_its_pairs(spark):
    import random

    rng, texts = random.Random(5), {}
    for i in range(60):
        names = [rng.choice([f"C{i}", f"D{i}", f"C{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 4))]
        texts[f"f{i}"] = "".join(f"class {n}({', '.join(rng.sample(['A', 'B', 'C', 'D', f'E{i % 5}'], rng.randrange(1, 4)))}):\n    pass\n" for n in names)
    texts |= {"solo": "class S(Other):\n    pass\n", "none": "def f():\n    pass\n"}
    ix = retrieval.CodeIndex.build(table(spark, **texts))
    want = {}
    for r in ix.siblings().pairs(ix.chunks).collect():
        want[r.file] = want.get(r.file, 0) + 1
    assert {r.file: r.siblings for r in ix.siblings().totals().collect()} == want and len(set(want.values())) > 5
    # siblings through two bases count once
    two = retrieval.CodeIndex.build(table(spark, a="class X(P, Q):\n    pass\n", b="class Y(P, Q):\n    pass\n", c="class Z(Q):\n    pass\n")).siblings()
    assert {r.file: r.siblings for r in two.totals().collect()} == {"a.py": 2, "b.py": 2, "c.py": 2}


def test_sharers_are_counted_without_pairs(spark):
    import random

    from verdigris.operators.sharers import sharers

    rng = random.Random(6)
    rows = [(side, owner, rng.choice([0, rng.randrange(200)]) if side else rng.randrange(4000)) for side in (0, 1) for owner in range(side * 1000, side * 1000 + 300) for _ in range(rng.randrange(1, 6))]
    rows += [(2, 5000, 1), (2, 5000, 1), (None, 5001, 1), (2, None, 1), (2, 5002, None)]
    df = spark.createDataFrame(rows, "side long, owner long, trait int")
    have = {}
    for side, owner, trait in rows:
        if None not in (side, owner, trait):
            have.setdefault((side, owner), set()).add(trait)
    want = {k: sum(j[0] == k[0] and not v.isdisjoint(w) for j, w in have.items()) for k, v in have.items()}
    for asking, counted in ((1 << 16, 1 << 18), (40, 100), (1, 1000)):
        assert {(r.side, r.owner): r.n for r in sharers(df, asking, counted).collect()} == want
    # one trait of all makes no row for a pair
    one = sharers(spark.range(3000).selectExpr("0 as side", "id as owner", "7 as trait"))
    assert {r.n for r in one.collect()} == {3000}
