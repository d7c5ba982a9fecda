"""The 23 review rules as column expressions over syntax facts.

Every rule looks at one row of facts and gives an array of (message, line, end_line), empty if it has nothing to say.
``findings`` evaluates all rules in one projection over one scan; nothing is shuffled before duplicates go.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import messages as M

HIT = "array<struct<message:string,line:int,end_line:int>>"


@dataclass(frozen=True)
class Rule:
    code: str
    name: str
    category: str
    severity: str
    title: str
    guard: str = ""


#: Codes, names, categories and severities, in the order in which rules report.
RULES: dict[str, Rule] = {
    r.code: r
    for r in (
        Rule("PY001", "prefer_list_comprehension", "pythonic", "SUGGESTION", "A comprehension builds this list", "Loops whose appended value is a call, await or yield."),
        Rule("PY004", "prefer_enumerate", "pythonic", "SUGGESTION", "enumerate gives index and value"),
        Rule("PY007", "prefer_identity_vs_equality", "pythonic", "SUGGESTION", "None is compared by identity"),
        Rule("PY009", "prefer_defaultdict", "pythonic", "SUGGESTION", "A defaultdict makes missing lists"),
        Rule("PY002", "prefer_f_string", "pythonic", "SUGGESTION", "An f-string joins text and values", "Two literals."),
        Rule("PY003", "prefer_with_open", "pythonic", "SUGGESTION", "A with statement closes the file", "Anything below a with statement."),
        Rule("PY005", "prefer_zip", "pythonic", "SUGGESTION", "zip walks sequences in parallel"),
        Rule("PY006", "prefer_dict_get", "pythonic", "SUGGESTION", "dict.get looks up once", "Conditions with an else branch."),
        Rule("PY010", "prefer_any_all", "pythonic", "SUGGESTION", "any() and all() test a condition"),
        Rule("PY008", "prefer_str_join", "pythonic", "SUGGESTION", "join builds text from parts"),
        Rule("PY011", "prefer_pathlib", "pythonic", "SUGGESTION", "pathlib handles paths"),
        Rule("PY012", "prefer_dataclass", "pythonic", "SUGGESTION", "A dataclass holds attributes"),
        Rule("PY013", "prefer_key_sorted", "pythonic", "SUGGESTION", "key= orders values"),
        Rule("PY014", "prefer_next_gen", "pythonic", "SUGGESTION", "next() finds the first item"),
        Rule("PY015", "prefer_removeprefix", "pythonic", "SUGGESTION", "removeprefix and removesuffix cut ends"),
        Rule("DES005", "excessive_nesting", "design", "WARNING", "Blocks are nested deeply", "Functions and classes are no levels; an if inside an if adds none."),
        Rule("DES006", "nested_function", "design", "SUGGESTION", "A function hides in another", "Decorated functions and callbacks."),
        Rule("PY016", "prefer_top_level_imports", "pythonic", "SUGGESTION", "Imports belong at the top", "Under try or TYPE_CHECKING, and in test modules."),
        Rule("DES001", "large_class", "design", "INFO", "A class has grown large"),
        Rule("DES002", "many_init_params", "design", "WARNING", "A constructor takes many parameters"),
        Rule("DES003", "duplicated_block", "design", "SUGGESTION", "Statements repeat in one scope"),
        Rule("DES004", "duplicated_method", "design", "SUGGESTION", "Method bodies repeat"),
        Rule("DES007", "unused_instance_attribute", "design", "SUGGESTION", "An attribute is set but not read", "Dataclasses, classes without methods, caches."),
    )
}

#: Limits, function names and prefixes of the rules.
MAX_DEPTH, MAX_CLASS_LINES, MAX_INIT_PARAMS = 3, 100, 5
PATH_FUNCTIONS = ["join", "basename", "dirname", "splitext", "exists", "isfile", "isdir", "normpath", "abspath", "relpath", "realpath", "expanduser"]
PATH_NAMES = {"join": "/", "basename": "name", "dirname": "parent", "splitext": "suffix"}
WRITE_ONLY = ["_cache", "_lazy", "_memo"]

c = F.col
FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef")


def hit(message: Column, line: Column | None = None, end_line: Column | None = None) -> Column:
    return F.struct(message.alias("message"), (c("line") if line is None else line).cast("int").alias("line"), (F.lit(0) if end_line is None else end_line).cast("int").alias("end_line"))


def when(condition: Column, message: Column) -> Column:
    """One finding at the row's own line where the condition is true."""
    return F.when(condition, F.array(hit(message)))


def text(template: str, *parts: Column) -> Column:
    """template with each {} replaced."""
    pieces = template.split("{}")
    return F.concat(F.lit(pieces[0]), *[x for p, t in zip(parts, pieces[1:], strict=True) for x in (p.cast("string"), F.lit(t))])


def list_comprehension() -> Column:
    return when((c("kind") == "For") & F.array_contains("scope_lists", c("append_base")), text(M.LIST_COMP, c("append_base")))


def f_string() -> Column:
    return when((c("kind") == "BinOp") & (c("op") == "Add") & (c("left_str") != c("right_str")), F.lit(M.F_STRING))


def with_open() -> Column:
    return when((c("kind") == "Call") & (c("name") == "open") & ~c("in_with"), F.lit(M.WITH_OPEN))


def enumerate_index() -> Column:
    first = F.get(F.filter("subscripts", lambda s: s["seq"] != c("target")), F.lit(0))["seq"]
    return when((c("kind") == "For") & c("range_len") & first.isNotNull(), text(M.ENUMERATE, first, first))


def zip_sequences() -> Column:
    names = F.array_distinct(F.transform("subscripts", lambda s: s["seq"]))
    return when((c("kind") == "For") & c("range_len") & (F.size(names) >= 2), text(M.ZIP, F.array_join(names, ", ")))


def dict_get() -> Column:
    used = F.exists("subscripts", lambda s: (s["seq"] == c("container")) & (s["idx"] == c("member")))
    return when((c("kind") == "If") & ~c("has_else") & used, F.lit(M.DICT_GET))


def identity() -> Column:
    return when((c("kind") == "Compare") & c("none_equality"), F.lit(M.IDENTITY))


def str_join() -> Column:
    return when(c("kind").isin("For", "While") & F.array_contains("scope_strs", c("concat_base")), text(M.STR_JOIN, c("concat_base")))


def defaultdict() -> Column:
    named = c("container").isNotNull() & c("member").isNotNull()
    return when((c("kind") == "If") & named & c("body_append") & c("else_assign"), F.lit(M.DEFAULTDICT))


def _loop() -> Column:
    return c("kind").isin("For", "AsyncFor")


def any_all() -> Column:
    tests = F.when((c("body_returns") == "true") & (c("next_returns") == "false"), "any").when((c("body_returns") == "false") & (c("next_returns") == "true"), "all")
    return when(_loop() & ~c("body_else") & tests.isNotNull(), text(M.ANY_ALL, tests))


def next_item() -> Column:
    return when(_loop() & (c("body_returns") == "item") & c("next_returns").isNotNull(), F.lit(M.NEXT))


def pathlib_name(function: Column) -> Column:
    """What stands for an os.path function in pathlib."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PATH_NAMES.items() for x in kv])[function], F.concat(function, F.lit("()")))


def pathlib() -> Column:
    fits = (c("kind") == "Call") & (c("call_form") == "attribute") & (c("call_owner") == "path") & c("name").isin(PATH_FUNCTIONS)
    return when(fits, text(M.PATHLIB, c("name"), pathlib_name(c("name"))))


def dataclass_candidate() -> Column:
    return when((c("kind") == "ClassDef") & ~c("is_dataclass") & (c("n_attrs") >= 2) & (c("n_methods") == 0), text(M.DATACLASS, c("name")))


def sort_key() -> Column:
    called = (c("call_form") == "name") & c("name").isin("sorted", "max", "min") | (c("call_form") == "attribute") & (c("name") == "sort")
    return when((c("kind") == "Call") & called & F.array_contains("lambda_args", 2), F.lit(M.KEY))


def remove_prefix() -> Column:
    return when((c("kind") == "Subscript") & c("slice_form").isNotNull(), F.lit(M.REMOVE))


def nesting() -> Column:
    return when(c("depth") > MAX_DEPTH, text(M.NESTING, F.lit(MAX_DEPTH), c("depth")))


def nested_function() -> Column:
    fits = c("kind").isin(*FUNCTION_KINDS) & c("outer_passed").isNotNull() & ~c("decorated") & ~F.array_contains("outer_passed", c("name"))
    return when(fits, text(M.NESTED_DEF, c("name")))


def top_imports() -> Column:
    fits = c("kind").isin("Import", "ImportFrom") & (c("fn_depth") > 0) & (c("try_depth") == 0) & (c("type_checking_depth") == 0) & ~c("test_module")
    return when(fits, text(M.TOP_IMPORT, c("imported")))


def large_class() -> Column:
    return when((c("kind") == "ClassDef") & (c("span") > MAX_CLASS_LINES), text(M.LARGE_CLASS, c("name"), c("span")))


def init_params() -> Column:
    return when(c("kind").isin(*FUNCTION_KINDS) & (c("name") == "__init__") & (c("n_params") > MAX_INIT_PARAMS), text(f"__init__ has {{}} parameters (max {MAX_INIT_PARAMS}). Consider a config object or dataclass.", c("n_params")))


def duplicated_block() -> Column:
    """Windows of three statements of a run, sorted by shape: the first of each shape and the next that does not overlap it.

    Only windows that begin one or two statements later in the first one's run overlap it, so looking at the next
    three in order is enough."""
    triples = F.transform(
        F.sequence(F.lit(0), F.size("stmts") - 3),
        lambda i: F.struct(
            F.concat_ws("\n", c("stmts")[i]["shape"], c("stmts")[i + 1]["shape"], c("stmts")[i + 2]["shape"]).alias("key"), i.alias("ord"), c("stmts")[i]["run"].alias("run"), c("stmts")[i + 2]["run"].alias("last"),
            c("stmts")[i]["pos"].alias("pos"), c("stmts")[i]["line"].alias("line"), c("stmts")[i + 2]["end_line"].alias("end_line"),
        ),
    )
    ordered = F.array_sort(F.filter(triples, lambda w: w["run"] == w["last"]))

    def hits(w: Column) -> Column:
        def second(i: Column) -> Column:
            return F.get(F.filter(F.slice(w, i + 2, F.lit(3)), lambda o: (o["key"] == w[i]["key"]) & ((o["run"] != w[i]["run"]) | (o["pos"] >= w[i]["pos"] + 3))), F.lit(0))["line"]

        firsts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.coalesce(F.get(w, i - 1)["key"] != w[i]["key"], F.lit(True)) & second(i).isNotNull())
        firsts = F.array_sort(F.transform(firsts, lambda i: F.struct(w[i]["ord"].alias("o"), i.alias("i"))))
        return F.transform(firsts, lambda f: hit(text(M.DUP_BLOCK, w[f["i"]]["line"], second(f["i"])), w[f["i"]]["line"], w[f["i"]]["end_line"]))

    fits = c("kind").isin("ClassDef", *FUNCTION_KINDS) & (F.size("stmts") >= 6)
    # one lambda binds the sorted windows, so that they are made once
    return F.when(fits, F.flatten(F.transform(F.filter(F.array(ordered), lambda w: F.size(w) >= 2), hits)))


def duplicated_method() -> Column:
    """Methods sorted by body: the first of each body and the one after it."""

    def hits(m: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(m) - 2), lambda i: (m[i]["key"] == m[i + 1]["key"]) & F.coalesce(F.get(m, i - 1)["key"] != m[i]["key"], F.lit(True)))
        firsts = F.array_sort(F.transform(firsts, lambda i: F.struct(m[i]["ord"].alias("o"), i.alias("i"))))
        return F.transform(firsts, lambda f: hit(text(M.DUP_METHOD, *(m[f["i"] + k][n] for k in (0, 1) for n in ("cls", "name"))), m[f["i"]]["line"]))

    return F.when((c("kind") == "Module") & (F.size("methods") >= 2), F.flatten(F.transform(F.array(F.array_sort("methods")), hits)))


def unused_attribute() -> Column:
    kept = F.filter("writes", lambda w: ~F.array_contains("reads", w["attr"]) & ~F.exists(F.array(*map(F.lit, WRITE_ONLY)), lambda p: F.startswith(w["attr"], p)))
    message = lambda w: text(M.UNUSED, w["attr"], c("name"))
    return F.when((c("kind") == "ClassDef") & ~c("is_dataclass") & (c("n_plain_methods") > 0), F.transform(kept, lambda w: hit(message(w), w["line"])))


#: What a rule says of a row of facts.
EXPRESSIONS: dict[str, Callable[[], Column]] = {
    "PY001": list_comprehension, "PY002": f_string, "PY003": with_open, "PY004": enumerate_index, "PY005": zip_sequences, "PY006": dict_get, "PY007": identity, "PY008": str_join,
    "PY009": defaultdict, "PY010": any_all, "PY011": pathlib, "PY012": dataclass_candidate, "PY013": sort_key, "PY014": next_item, "PY015": remove_prefix, "PY016": top_imports,
    "DES001": large_class, "DES002": init_params, "DES003": duplicated_block, "DES004": duplicated_method, "DES005": nesting, "DES006": nested_function, "DES007": unused_attribute,
}
#: Rules that report breadth first; the others report in source order.
BREADTH_FIRST = frozenset({"PY004", "PY005", "PY007", "PY009", "PY011"})


def get_rule(code: str) -> Rule:
    return RULES[code]


def register_rule(rule: Rule, expression: Callable[[], Column]) -> None:
    """Adds a rule after the others; expression gives an array of hit(...) for a row of facts, or null."""
    if rule.category not in ("pythonic", "design") or rule.severity not in ("INFO", "SUGGESTION", "WARNING"):
        raise ValueError(f"unknown category or severity in {rule}")
    if rule.code in RULES:
        raise ValueError(f"{rule.code} is taken")
    RULES[rule.code], EXPRESSIONS[rule.code] = rule, expression


def unregister_rule(code: str) -> None:
    del RULES[code], EXPRESSIONS[code]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.code, r.name, r.category, r.severity, r.title, r.guard) for r in RULES.values()], "code string, name string, category string, severity string, title string, guard string")


def findings(facts: DataFrame, keep: tuple[str, ...] = ("path",), codes: list[str] | None = None) -> DataFrame:
    """All that the rules find in facts: keep, the columns of a finding, and det_ord and emit_ord for its order."""
    order = {code: i for i, code in enumerate(RULES)}
    chosen = [code for code in RULES if codes is None or code in codes]
    if codes and (unknown := set(codes) - set(RULES)):
        raise KeyError(f"no such rules: {sorted(unknown)}")

    def labelled(code: str) -> Column:
        r = RULES[code]
        emitted = c("bfs") if code in BREADTH_FIRST else c("pre")
        found = F.coalesce(EXPRESSIONS[code](), F.array().cast(HIT))
        return F.transform(found, lambda h, i: F.struct(
            F.lit(code).alias("code"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), h["message"].alias("message"), h["line"].alias("line"), F.lit(0).alias("column"), h["end_line"].alias("end_line"),
            F.lit(order[code]).alias("det_ord"), emitted.alias("emit_ord"), i.alias("part_ord"),
        ))

    every = F.flatten(F.array(*map(labelled, chosen)))
    return facts.where("kind <> '__error__'").select(*keep, F.explode(every).alias("f")).select(*keep, "f.*")
