"""Queries that review programs built from table rows, each with SQL that predicts the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import analytics, report
from verdigris.operators.retrieval import CodeIndex, render_related
from verdigris.plans.rule_cases import CASES
from verdigris.sources.files import from_rows, spread
from verdigris.sources.parse import symbol_rows

#: Rules with long programs use the smaller table.
TABLE = {code: ("supplier", "s_suppkey") if code in ("DES001", "DES003", "DES004") else ("customer", "c_custkey") for code in CASES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def program(key: Column, sources: list[str]) -> Column:
    """The program of a key: one of sources by the key's remainder, with the key filled in."""
    return F.replace(F.element_at(F.array(*map(F.lit, sources)), (F.pmod(key, F.lit(len(sources))) + 1).cast("int")), F.lit("{k}"), key.cast("string"))


def rule_query(code: str):
    name, key = TABLE[code]
    sources = [s for s, _ in CASES[code]]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = table(spark, sf_dir, name).select(F.col(key).alias("key"), program(F.col(key), sources).alias("source"))
        return report.review(files, [code], ("key",)).select("key", "code", F.col("line").cast("long").alias("line"), "message")

    return run


def rule_oracle(code: str) -> str:
    name, key = TABLE[code]
    rows = [(i, line, message) for i, (_, found) in enumerate(CASES[code]) for line, message in found]
    values = ", ".join(f"({i}, {line}, {quoted(m)})" for i, line, m in rows)
    return f"SELECT t.{key} AS key, '{code}' AS code, v.line::BIGINT AS line, replace(v.message, '{{k}}', t.{key}::VARCHAR) AS message FROM {name} t JOIN (VALUES {values}) v(variant, line, message) ON t.{key} % {len(CASES[code])} = v.variant"


#: One program with findings of several rules and severities, by the key's remainder; (source, [(line, code, severity)]).
MIXED = [
    ("x{k} = 1\n", []),
    ("x = a{k} == None\n", [(1, "PY007", "SUGGESTION")]),
    ("def __init__(a{k}, b, c, d, e, f):\n    import os\n    return 'x' + a\n", [(1, "DES002", "WARNING"), (2, "PY016", "SUGGESTION"), (3, "PY002", "SUGGESTION")]),
    ("class C{k}:\n" + "    a = 1\n" * 101, [(1, "DES001", "INFO"), (1, "PY012", "SUGGESTION"), (2, "DES003", "SUGGESTION")]),
    ("x = a{k} == None  # noqa\ny = b == None  # noqa: PY007, PY002\nz = c == None  # noqa: PY002\nw = d == None  # noqa: foo\n", [(3, "PY007", "SUGGESTION")]),
]


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier")
    return n.select(F.concat(F.lit("f"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit(".py")).alias("path"), program(F.col("s_suppkey"), [s for s, _ in MIXED]).alias("source"), F.lit(None).cast("timestamp").alias("mtime"))


MIXED_SQL = "SELECT 'f' || lpad(t.s_suppkey::VARCHAR, 8, '0') || '.py' AS path, v.line::BIGINT AS line, v.code, v.severity FROM supplier t JOIN (VALUES " + ", ".join(f"({i}, {line}, '{code}', '{sev}')" for i, (_, fs) in enumerate(MIXED) for line, code, sev in fs) + f") v(variant, line, code, severity) ON t.s_suppkey % {len(MIXED)} = v.variant"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the mixed programs, suppressed, in report order."""
    return report.review(mixed_files(spark, sf_dir)).select("path", F.col("line").cast("long").alias("line"), "code", "severity").orderBy("path", "line", "code")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mixed_files(spark, sf_dir)
    return report.summary(files, report.review(files))


SUMMARY_SQL = f"""WITH f AS ({MIXED_SQL}), p AS (SELECT s_suppkey % {len(MIXED)} AS variant FROM supplier)
SELECT (SELECT count(*) FROM p)::BIGINT AS reviewed, (SELECT count(*) FROM p WHERE variant = 0)::BIGINT AS clean, (SELECT count(*) FROM p WHERE variant <> 0)::BIGINT AS dirty,
count(*) FILTER (WHERE severity = 'WARNING')::BIGINT AS warnings, count(*) FILTER (WHERE severity = 'SUGGESTION')::BIGINT AS suggestions, count(*) FILTER (WHERE severity = 'INFO')::BIGINT AS info FROM f"""


def clean_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mixed_files(spark, sf_dir)
    return report.clean_first_places(files, report.review(files)).select("path", "n", "place")


CLEAN_FIRST_SQL = f"""WITH f AS ({MIXED_SQL}), p AS (SELECT 'f' || lpad(s_suppkey::VARCHAR, 8, '0') || '.py' AS path FROM supplier),
n AS (SELECT p.path, count(f.code)::BIGINT AS n FROM p LEFT JOIN f ON p.path = f.path GROUP BY p.path) SELECT path, n, row_number() OVER (ORDER BY n > 0, path)::BIGINT AS place FROM n"""


def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_category(report.review(mixed_files(spark, sf_dir))).select("path", "category", "n", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


BY_CATEGORY_SQL = f"WITH f AS ({MIXED_SQL}) SELECT path, CASE WHEN code LIKE 'DES%' THEN 'design' ELSE 'pythonic' END AS category, count(*)::BIGINT AS n, string_agg(code, ',' ORDER BY line, code) AS codes FROM f GROUP BY ALL"


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mixed_files(spark, sf_dir)
    j = report.json_reports(files, report.review(files))
    parsed = F.from_json("json", "path string, issues array<struct<code:string,line:bigint,severity:string>>")
    return j.select("path", parsed.alias("j")).select("path", F.size("j.issues").cast("long").alias("n"), F.array_join(F.transform("j.issues", lambda i: F.concat_ws(":", i["line"], i["code"], i["severity"])), ";").alias("issues"))


JSON_SQL = f"""WITH f AS ({MIXED_SQL}), p AS (SELECT 'f' || lpad(s_suppkey::VARCHAR, 8, '0') || '.py' AS path FROM supplier)
SELECT p.path, count(f.code)::BIGINT AS n, coalesce(string_agg(f.line || ':' || f.code || ':' || f.severity, ';' ORDER BY f.line, CASE WHEN f.code LIKE 'DES%' THEN 0 ELSE 1 END, f.code), '') AS issues FROM p LEFT JOIN f ON p.path = f.path GROUP BY p.path"""


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.export_lines(report.review(mixed_files(spark, sf_dir)))
    return rows.select("path", F.size(F.filter(F.split("value", "\n"), lambda x: F.length(x) > 0)).cast("long").alias("lines"), F.regexp_extract("value", "^([^\n]*)", 1).alias("head"))


EXPORT_SQL = f"WITH f AS ({MIXED_SQL}) SELECT path, (count(*) + 1)::BIGINT AS lines, '── ' || path || ' ──' AS head FROM f GROUP BY path"


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mixed_files(spark, sf_dir)
    out = report.text_lines(files, report.review(files))
    return out.select("path", (F.col("rendered") == "Check complete, good code!\n").alias("good"), F.regexp_extract("rendered", r"  (PY007|DES002|DES001)  (\w+)  (L\d+)", 3).alias("first"), F.size(F.split("rendered", "\n      \\d+ \\| ")).cast("long").alias("pieces"))


TEXT_SQL = """SELECT 'f' || lpad(s_suppkey::VARCHAR, 8, '0') || '.py' AS path, s_suppkey % 5 = 0 AS good,
CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 4 THEN 'L3' ELSE 'L1' END AS first, CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE 2 END::BIGINT AS pieces FROM supplier"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report.diagnostics(report.review(mixed_files(spark, sf_dir)))
    return d.select("path", F.col("line").cast("long").alias("line"), F.col("to_column").cast("long").alias("to_column"), "level", "code")


DIAGNOSTICS_SQL = f"WITH f AS ({MIXED_SQL}) SELECT path, greatest(line - 1, 0)::BIGINT AS line, 1000::BIGINT AS to_column, CASE severity WHEN 'WARNING' THEN 'Warning' WHEN 'INFO' THEN 'Information' ELSE 'Hint' END AS level, code FROM f"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.links(report.review(mixed_files(spark, sf_dir)), editor=True).select("path", "code", "uri")


LINKS_SQL = f"WITH f AS ({MIXED_SQL}) SELECT path, code, 'vscode://file' || path || ':' || line AS uri FROM f"


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    files = t.select(F.col("c_custkey").alias("key"), program(F.col("c_custkey"), ["x = 1\n", "y = 2\n\ndef broken{k}(:\n", "z = a == None\n"]).alias("source"))
    bad = report.errors(files, ("key",)).select("key", F.lit("error").alias("kind"), F.col("line").cast("long").alias("line"))
    good = report.review(files, None, ("key",)).select("key", F.col("code").alias("kind"), F.col("line").cast("long").alias("line"))
    return bad.unionByName(good)


PARSE_ERRORS_SQL = "SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 1 THEN 'error' ELSE 'PY007' END AS kind, CASE c_custkey % 3 WHEN 1 THEN 3 ELSE 1 END::BIGINT AS line FROM customer WHERE c_custkey % 3 <> 0"


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.functions.text import noqa_rows

    lines = ["x = 1", "y = 2  # noqa", "z = 3  # noqa: PY00{k}", "w = 4  #noqa:PY007 , DES003 - why", "v = 5  # noqa: foo", "u = 6  # NOQA"]
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("#\n"), program(F.col("c_custkey"), lines)).alias("source"))
    return noqa_rows(files, ("key",)).select("key", F.col("line").cast("long").alias("line"), F.coalesce("code", F.lit("*")).alias("code"))


SUPPRESSIONS_SQL = """SELECT c_custkey AS key, 2::BIGINT AS line, replace(v.code, '{k}', c_custkey::VARCHAR) AS code FROM customer
JOIN (VALUES (1, '*'), (2, 'PY00{k}'), (3, 'PY007'), (3, 'DES003'), (4, '*')) v(variant, code) ON c_custkey % 6 = v.variant"""

MODULES = [
    ("class Base{k}:\n    'Top.'\n    a = 1\n    b: int\n    def m(self, x, *y, z, **w):\n        'Does m.\n        More.'\n", "class", "Base{k}", "class Base{k}", "Top.", "attrs: a, b; methods: m(self, x, *y, *, z, **w) — Does m."),
    ("import os\nasync def fn{k}(a, b=1, *, c):\n    return a\n", "function", "fn{k}", "def fn{k}(a, b, *, c)", "", ""),
    ("class Kid{k}(pkg.Base, Other, metaclass=M):\n    pass\n", "class", "Kid{k}", "class Kid{k}(Base, Other)", "", ""),
    ("x{k} = 1\n", None, None, None, None, None),
]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), program(F.col("c_custkey"), [m[0].replace("'Does m.\n        More.'", "'''Does m.\n        More.'''") for m in MODULES]).alias("source"))
    return symbol_rows(spread(files, "key"), ("key",)).where("kind = 'chunk'").select("key", F.col("chunk_kind").alias("kind"), "symbol", "signature", "docstring", "body")


CHUNKS_SQL = "SELECT c_custkey AS key, v.kind, " + ", ".join(f"replace(v.{c}, '{{k}}', c_custkey::VARCHAR) AS {c}" for c in ("symbol", "signature", "docstring", "body")) + " FROM customer JOIN (VALUES " + ", ".join(f"({i}, {', '.join(quoted(x) for x in m[1:])})" for i, m in enumerate(MODULES) if m[1]) + ") v(variant, kind, symbol, signature, docstring, body) ON c_custkey % 4 = v.variant"


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project of one file for each supplier: a base in its nation's package, or a class that imports and inherits it."""
    t = table(spark, sf_dir, "supplier")
    nation, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    base = F.concat(F.lit("class B"), nation, F.lit(":\n    'Base.'\n"))
    kid = F.concat(F.lit("import n"), nation, F.lit(".base.sub\nfrom n"), nation, F.lit(".base import B"), nation, F.when(F.col("s_suppkey") % 3 == 0, F.lit("\nimport json")).otherwise(""), F.lit("\nclass K"), key, F.lit("(B"), nation, F.lit("):\n    pass\n"))
    kids = t.select(F.concat(F.lit("n"), nation, F.lit("/k"), key, F.lit(".py")).alias("path"), kid.alias("source"))
    bases = t.select("s_nationkey").distinct().select(F.concat(F.lit("n"), nation, F.lit("/base.py")).alias("path"), base.alias("source"))
    return kids.unionByName(bases).withColumn("mtime", F.lit(None).cast("timestamp"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_related(CodeIndex.build(project(spark, sf_dir)).related())


RELATED_SQL = "SELECT 'n' || s_nationkey || '/k' || s_suppkey || '.py' AS for_file, '  n' || s_nationkey || '/base.py: class B' || s_nationkey || ' — class B' || s_nationkey || chr(10) || '      Base.' AS related FROM supplier"


def imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeIndex.build(project(spark, sf_dir)).imported_files()


IMPORTED_SQL = "SELECT 'n' || s_nationkey || '/k' || s_suppkey || '.py' AS file, 'n' || s_nationkey || '/base.py' AS target FROM supplier"


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many siblings each file has, through whichever base."""
    return CodeIndex.build(project(spark, sf_dir)).siblings().totals()


SIBLINGS_SQL = "WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT 'n' || s.s_nationkey || '/k' || s_suppkey || '.py' AS file, (n.n - 1)::BIGINT AS siblings FROM supplier s JOIN n ON s.s_nationkey = n.s_nationkey WHERE n.n > 1"


def siblings_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeIndex.build(project(spark, sf_dir)).siblings_match()


MATCH_SQL = """WITH n AS (SELECT s_nationkey, s_suppkey % 3 = 0 AS json, count(*) AS n FROM supplier GROUP BY ALL)
SELECT 'n' || s.s_nationkey || '/k' || s_suppkey || '.py' AS file, n.n > 1 AS matches FROM supplier s JOIN n ON s.s_nationkey = n.s_nationkey AND (s_suppkey % 3 = 0) = n.json
UNION ALL SELECT DISTINCT 'n' || s_nationkey || '/base.py', false FROM supplier"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeIndex.build(project(spark, sf_dir)).signatures().select("file", F.array_join("modules", ",").alias("modules"), F.array_join("bases", ",").alias("bases"))


SIGNATURES_SQL = """SELECT 'n' || s_nationkey || '/k' || s_suppkey || '.py' AS file, CASE WHEN s_suppkey % 3 = 0 THEN 'json,' ELSE '' END || 'n' || s_nationkey || '.base,n' || s_nationkey || '.base.sub' AS modules, 'B' || s_nationkey AS bases FROM supplier
UNION ALL SELECT DISTINCT 'n' || s_nationkey || '/base.py', '', '' FROM supplier"""


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imports and inherits what, from a stored index after an update: a tenth of the files is new, a tenth gone, in a tenth of the classes the base has
    changed, and every tenth file's text differs without a new stamp, so that it must not have been parsed again."""
    from verdigris.operators.index_store import IndexStore
    from verdigris.operators.scratch import folder

    key = F.regexp_extract("path", r"/k(\d+)", 1)
    number = F.when(key != "", key.cast("long") % 10).otherwise(-1)
    files = project(spark, sf_dir).withColumns({"n": number, "mtime": F.timestamp_seconds(F.lit(1000))})
    changed = F.regexp_replace("source", r"\(B\d+\)", "(Other)")
    now = files.where("n <> 4").withColumns({"source": F.when(F.col("n") == 5, changed).when(F.col("n") == 6, "").otherwise(F.col("source")), "mtime": F.when(F.col("n") == 5, F.timestamp_seconds(F.lit(2000))).otherwise(F.col("mtime"))})
    store = IndexStore(spark, folder(spark, "index"))
    store.update(files.where("n <> 3").drop("n"))
    parsed = store.update(now.drop("n"))
    return store.index().signatures().select("file", F.array_join("modules", ",").alias("modules"), F.array_join("bases", ",").alias("bases"), F.lit(parsed).cast("long").alias("parsed"))


REFRESH_SQL = """WITH p AS (SELECT count(*) FILTER (WHERE s_suppkey % 10 IN (3, 5))::BIGINT AS parsed FROM supplier)
SELECT 'n' || s_nationkey || '/k' || s_suppkey || '.py' AS file, CASE WHEN s_suppkey % 3 = 0 THEN 'json,' ELSE '' END || 'n' || s_nationkey || '.base,n' || s_nationkey || '.base.sub' AS modules, CASE WHEN s_suppkey % 10 = 5 THEN 'Other' ELSE 'B' || s_nationkey END AS bases, parsed FROM supplier, p WHERE s_suppkey % 10 <> 4
UNION ALL SELECT DISTINCT 'n' || s_nationkey || '/base.py', '', '', parsed FROM supplier, p"""


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed programs reviewed from stored facts, after an update in which every fifth file has become another one."""
    from verdigris.operators.index_store import FactStore, by_content
    from verdigris.operators.scratch import folder

    files = mixed_files(spark, sf_dir)
    store = FactStore(spark, folder(spark, "facts"), by_content)
    store.update(files.withColumn("source", F.when(F.col("source").startswith("x = a"), "z = 1\n").otherwise(F.col("source"))))
    parsed = store.update(files)
    return store.review().select("path", F.col("line").cast("long").alias("line"), "code", "severity", F.lit(parsed).cast("long").alias("parsed"))


STORED_SQL = f"WITH f AS ({MIXED_SQL}) SELECT f.*, (SELECT count(*) FROM supplier WHERE s_suppkey % {len(MIXED)} IN (1, 4))::BIGINT AS parsed FROM f"


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_rules(report.review(mixed_files(spark, sf_dir)), 2).withColumn("rank", F.col("rank").cast("long"))


TOP_RULES_SQL = f"WITH f AS ({MIXED_SQL}), g AS (SELECT CASE WHEN code LIKE 'DES%' THEN 'design' ELSE 'pythonic' END AS category, code, count(*)::BIGINT AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, code)::BIGINT AS rank FROM g) SELECT * FROM r WHERE rank <= 2"


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mixed_files(spark, sf_dir)
    e = analytics.review_events(files, report.review(files), "s", "static")
    return e.select("target", "target_type", F.col("lines").cast("long").alias("lines"), F.size("issues").cast("long").alias("n"), F.array_join(F.transform("issues", lambda i: i["rule"]), ",").alias("rules"))


EVENTS_SQL = f"""WITH f AS ({MIXED_SQL}), p AS (SELECT 'f' || lpad(s_suppkey::VARCHAR, 8, '0') || '.py' AS path, s_suppkey % 5 AS variant FROM supplier)
SELECT p.path AS target, 'file' AS target_type, (CASE p.variant WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 103 ELSE 5 END)::BIGINT AS lines, count(f.code)::BIGINT AS n, coalesce(string_agg(f.code, ',' ORDER BY f.code), '') AS rules FROM p LEFT JOIN f ON p.path = f.path GROUP BY ALL"""


def stub_answer(messages: list[dict]) -> str:
    """A model that finds one thing wrong on the first line of every file but says it twice, and once on a line that is not there."""
    import json

    s = [{"line": 1, "message": " Name it better. ", "severity": "warning"}, {"line": 1, "message": "Name it better."}, {"line": 9999, "message": "No such line."}]
    return json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps({"suggestions": s})[:-1] + ",}\n```"}}]})


def model_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.operators.model_review import Client, review_with_model

    files = from_rows(table(spark, sf_dir, "supplier"), "concat('m', s_suppkey, '.py')", "concat(if(s_suppkey % 2 = 0, 'import os\\n', 'x = y == None\\n'), repeat('z = 1\\n', cast(s_suppkey % 12 as int)))")
    found, _ = review_with_model(files, Client(stub_answer))
    return found.select("path", "code", "severity", F.col("line").cast("long").alias("line"), "message")


MODEL_SQL = """SELECT 'm' || s_suppkey || '.py' AS path, 'PY007' AS code, 'SUGGESTION' AS severity, 1::BIGINT AS line, 'Use ''is None''/''is not None'' instead of ''== None''/''!= None''.' AS message FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT 'm' || s_suppkey || '.py', 'LLM001', 'WARNING', 1, 'Name it better.' FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 12 >= 9"""

def late_answer(messages: list[dict]) -> str:
    import json

    return json.dumps({"choices": [{"message": {"content": json.dumps({"suggestions": [{"line": 1, "message": "Asked later."}]})}}]})


def journal_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model reviews of two runs with one journal: what the first run asked about a third of the files, the second, whose model says something else, does
    not ask again."""
    from verdigris.operators.model_review import Client, review_with_model
    from verdigris.operators.scratch import folder

    files = from_rows(table(spark, sf_dir, "supplier"), "concat('m', s_suppkey, '.py')", "concat('k = ', s_suppkey, '\\n', repeat('z = 1\\n', 8 + cast(s_suppkey % 4 as int)))")
    journal, number = folder(spark, "answers"), F.regexp_extract("path", r"(\d+)", 1).cast("long")
    review_with_model(files.where(number % 3 == 0), Client(stub_answer), focuses=("logic",), journal=journal)
    found, _ = review_with_model(files, Client(late_answer), focuses=("logic",), journal=journal)
    return found.select("path", "code", F.col("line").cast("long").alias("line"), "message")


JOURNAL_SQL = "SELECT 'm' || s_suppkey || '.py' AS path, 'LLM001' AS code, 1::BIGINT AS line, CASE s_suppkey % 3 WHEN 0 THEN 'Name it better.' ELSE 'Asked later.' END AS message FROM supplier WHERE s_suppkey % 4 >= 1"

NAMED = {
    "journal_review": (journal_review, JOURNAL_SQL),
    "flagship_review": (flagship, MIXED_SQL), "review_summary": (summary, SUMMARY_SQL), "review_clean_first": (clean_first, CLEAN_FIRST_SQL), "review_by_category": (by_category, BY_CATEGORY_SQL), "review_json": (json_report, JSON_SQL),
    "review_export": (export, EXPORT_SQL), "review_text": (text_report, TEXT_SQL), "review_diagnostics": (diagnostics, DIAGNOSTICS_SQL), "review_links": (links, LINKS_SQL), "parse_errors": (parse_errors, PARSE_ERRORS_SQL),
    "noqa_suppressions": (suppressions, SUPPRESSIONS_SQL), "symbol_chunks": (chunks, CHUNKS_SQL), "related_structural": (related, RELATED_SQL), "imported_files": (imported_files, IMPORTED_SQL), "sibling_files": (siblings, SIBLINGS_SQL),
    "siblings_match": (siblings_match, MATCH_SQL), "structural_signatures": (signatures, SIGNATURES_SQL), "analytics_top_rules": (top_rules, TOP_RULES_SQL), "analytics_events": (usage_events, EVENTS_SQL), "model_review": (model_review, MODEL_SQL),
    "index_refresh": (index_refresh, REFRESH_SQL), "stored_facts": (stored_facts, STORED_SQL),
}
QUERIES = {f"rule_{c.lower()}": rule_query(c) for c in CASES} | {k: q for k, (q, _) in NAMED.items()}
ORACLES = {f"rule_{c.lower()}": rule_oracle(c) for c in CASES} | {k: s for k, (_, s) in NAMED.items()}
