"""The rules, case by case, in one job; framework and quirks."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators import report, rules
from verdigris.plans import registry
from verdigris.plans.rule_cases import CASES
from verdigris.sources import files, parse


def review(spark, source, codes=None):
    return [(r.code, r.line, r.message) for r in report.review(files.from_text(spark, source), codes).orderBy(*report.report_order()).collect()]


def test_every_case_of_every_rule(spark):
    cases = [(f"{code}/{i}", source.replace("{k}", "7"), sorted((n, m.replace("{k}", "7")) for n, m in found)) for code, own in CASES.items() for i, (source, found) in enumerate(own)]
    df = spark.createDataFrame([(n, s, None) for n, s, _ in cases], "path string, source string, mtime timestamp")
    got = {}
    for r in report.review(df).collect():
        if r.path.startswith(r.code + "/"):
            got.setdefault(r.path, []).append((r.line, r.message))
    for name, _, want in cases:
        assert sorted(got.get(name, [])) == want, name


def test_registry_holds_all_rules_in_order():
    assert len(rules.RULES) == 23 == len(rules.EXPRESSIONS) and set(rules.RULES) == set(rules.EXPRESSIONS)
    assert list(rules.RULES)[:4] == ["PY001", "PY004", "PY007", "PY009"] and list(rules.RULES)[-1] == "DES007"
    assert {c for c, r in rules.RULES.items() if r.severity == "WARNING"} == {"DES002", "DES005"} and rules.get_rule("DES001").severity == "INFO"
    with pytest.raises(KeyError):
        rules.get_rule("PY999")


def test_rules_can_be_added(spark):
    long_name = rules.Rule("PY900", "long_name", "pythonic", "INFO", "A long name")
    rules.register_rule(long_name, lambda: rules.when((F.col("kind") == "FunctionDef") & (F.length("name") > 20), rules.text("'{}' is long.", F.col("name"))))
    try:
        assert review(spark, "def this_is_a_very_long_function_name():\n    pass\n") == [("PY900", 1, "'this_is_a_very_long_function_name' is long.")]
        with pytest.raises(ValueError):
            rules.register_rule(long_name, rules.identity)
    finally:
        rules.unregister_rule("PY900")
    with pytest.raises(ValueError):
        rules.register_rule(rules.Rule("X1", "x", "style", "INFO", ""), rules.identity)


def test_duplicates_order_and_suppressions(spark):
    source = "def __init__(a, b, c, d, e, f):\n    import os\n    return 'x' + (a == None) + 'y'\nx = y == None  # noqa: PY002\nz = y == None  # noqa: PY007 - known\nw = y == None  # noqa: foo\n"
    assert [(c, n) for c, n, _ in review(spark, source)] == [("DES002", 1), ("PY016", 2), ("PY002", 3), ("PY007", 3), ("PY007", 4)]
    once = report.keep_first(rules.findings(parse.syntax_facts(files.from_text(spark, source))))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, report.keep_first(once).collect()))
    with pytest.raises(KeyError):
        review(spark, source, ["PY999"])


def test_broken_files_are_rows_and_disturb_none(spark):
    df = spark.createDataFrame([("a", "def broken(:\n", None), ("b", "x = y == None\n", None), ("c", "x = 1\0", None), ("d", None, None), ("e", "", None), ("f", "(" * 300 + ")" * 300, None)], "path string, source string, mtime timestamp")
    assert {r.path for r in report.errors(df).collect()} == {"a", "c", "d", "f"}
    assert [(r.path, r.code) for r in report.review(df).collect()] == [("b", "PY007")]
    assert report.exit_code(df) == 1 and report.exit_code(df.where("path = 'b'")) == 0


def test_order_of_files_and_partitions_changes_nothing(spark):
    rows = [(f"p{i}", CASES[c][0][0], None) for i, c in enumerate(CASES)]
    a = spark.createDataFrame(rows, "path string, source string, mtime timestamp")
    b = spark.createDataFrame(rows[::-1], "path string, source string, mtime timestamp").repartition(7)
    assert sorted(map(tuple, report.review(a).collect())) == sorted(map(tuple, report.review(b).collect()))


def test_all_rules_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "files")
    files.from_text(spark, "x = 1\n").write.parquet(path)
    plan = rules.findings(parse.syntax_facts(spark.read.parquet(path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("for i in range(len(a)):\n    b[i] = i[i]\n", ["PY004", "PY005"]),  # the index itself counts as a sequence for PY005 only
        ("def f():\n    for x in y:\n        if not q:\n            return True\n    return False\n", ["PY010"]),
        ("class A:\n    def m(self):\n        a = 1\n        b = 2\n        return b\n    def n(self):\n        a = 1\n        b = 2\n        return b\n", ["DES004"]),
        ("async def f(xs):\n    out = []\n    async for x in xs:\n        out.append(x)\n", []),
        ("try:\n    pass\nexcept* E:\n    def f():\n        import os\n", ["PY016"]),
        ("def f():\n    while a:\n        async with b:\n            match c:\n                case 1:\n                    for d in e:\n                        pass\n", []),
    ],
)
def test_quirks(spark, source, want):
    if "async with" in source:
        source, want = "async " + source, ["DES005"]
    assert [c for c, _, _ in review(spark, source)] == want


def test_shape_of_text():
    assert parse.shape("foo_1 = bar(12, 'a b')  + é9") == "N = N(C, 'N N')  + N"
    assert parse.shape("  x\t= 0x1F\n") == "N = CN"


def test_texts_are_dealt_out_before_they_are_parsed(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.range(400).select(F.lit("same.py").alias("path"), F.format_string("x%d = 1\n", "id").alias("source"), F.lit(None).cast("timestamp").alias("mtime"))
    rows.coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert df.rdd.getNumPartitions() == 1
    shares = [r["count"] for r in files.spread(df, "path").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 4 and max(shares) < 200 and sum(shares) == 400
    assert files.spread(df, "path").columns == ["path", "source"]
    from verdigris.operators import model_review

    for found in (report.review(df), report.errors(df), model_review.source_views(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow") :]


@pytest.mark.parametrize("code", ["PY005", "PY001", "PY014", "PY004", "PY012", "DES006", "DES005"])
def test_a_rule_query_deals_out_a_table_of_one_split(spark, tmp_path, code):
    spark.range(400).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = registry.QUERIES[f"rule_{code.lower()}"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow") :]
    want = [(k, code, line, m.replace("{k}", str(k))) for k in range(400) for line, m in CASES[code][k % len(CASES[code])][1]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
