"""Reports: duplicates, order, suppressions, summaries and their presentation."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.text import noqa_rows
from verdigris.operators.scratch import keep as keep_table
from verdigris.sources.files import spread

FIELDS = ["code", "category", "severity", "message", "line", "column", "end_line"]
ORDER = ["det_ord", "emit_ord", "part_ord"]


def keep_first(findings: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The first finding of each code, line and message of a file, in reporting order."""
    first = F.row_number().over(Window.partitionBy(*keep, "code", "line", "message").orderBy(*ORDER))
    return findings.withColumn("_n", first).where("_n = 1").drop("_n")


def report_order(keep: tuple[str, ...] = ("path",)) -> list[str]:
    return [*keep, "line", "category", "code", *ORDER]


def suppress(findings: DataFrame, suppressions: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """findings without those on a line with a bare suppression, or one of their code: two equi anti-joins."""
    bare = suppressions.where("code is null").select(*keep, "line").distinct()
    scoped = suppressions.where("code is not null").select(*keep, "line", "code").distinct()
    return findings.join(bare, [*keep, "line"], "left_anti").join(scoped, [*keep, "line", "code"], "left_anti").select(findings.columns)


def review(files: DataFrame, codes: list[str] | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The findings of files (path, source): parsed once, all rules in one projection, first of equals, not suppressed."""
    from verdigris.sources.parse import syntax_facts

    return review_facts(syntax_facts(spread(files, *keep), keep), noqa_rows(files, keep), codes, keep)


def review_facts(facts: DataFrame, suppressions: DataFrame | None = None, codes: list[str] | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The findings of facts, as the parser gives them or as they were stored: rules need no text, so rules that are added later need no parse."""
    from verdigris.operators.rules import findings

    found = keep_first(findings(facts, keep, codes), keep)
    return found if suppressions is None else suppress(found, suppressions, keep)


def review_tree(spark: SparkSession, tree: ast.AST, path: str = "<tree>", codes: list[str] | None = None) -> DataFrame:
    """The findings of a tree that is parsed already. It holds no comments, so nothing is suppressed."""
    from verdigris.sources.parse import facts_table

    return review_facts(facts_table(spark, [(path, tree)]), None, codes)


def errors(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, line, error) of files that cannot be parsed."""
    from verdigris.sources.parse import syntax_facts

    return syntax_facts(spread(files, *keep), keep).where("kind = '__error__'").select(*keep, "line", "error")


def summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, clean and dirty ones, and findings by severity. Clean files have no finding rows: an outer join."""
    each = findings.groupBy("path").agg(*[F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("warning", "suggestion", "info")], F.count("*").alias("n"))
    joined = files.select("path").join(each, "path", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.agg(F.count("*").alias("reviewed"), F.count_if(n == 0).alias("clean"), F.count_if(n > 0).alias("dirty"), *[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"{s}s" if s != "info" else s) for s in ("warning", "suggestion", "info")])


def by_category(findings: DataFrame) -> DataFrame:
    """(path, category, n, issues) with issues in report order."""
    return findings.groupBy("path", "category").agg(F.count("*").alias("n"), _issues(F.struct("line", "category", "code", *ORDER, *[F.col(f).alias(f"_{f}") for f in FIELDS])).alias("issues"))


def _issues(row: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(*[r[f"_{f}"].alias(f) for f in FIELDS]))


def reports(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, issues) of every file, clean ones with no issues."""
    row = F.struct("line", "category", "code", *ORDER, *[F.col(f).alias(f"_{f}") for f in FIELDS])
    some = findings.groupBy("path").agg(_issues(row).alias("issues"))
    empty = F.array().cast(some.schema["issues"].dataType)
    return files.select("path").join(some, "path", "left").withColumn("issues", F.coalesce("issues", empty))


def json_reports(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, json): an object of path and issues for every file."""
    return reports(files, findings).select("path", F.to_json(F.struct("path", "issues")).alias("json"))


def culprit(source: Column, line: Column) -> Column:
    """The source's line of that number, null outside of it."""
    return F.when(line >= 1, F.try_element_at(F.split(source, "\n", -1), line.cast("int")))


def text_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, rendered): the printed report of every file; a clean one says so."""
    w = Window.partitionBy("path").orderBy("line", "category", "code", *ORDER)
    lines = findings.join(files.select("path", "source"), "path")
    lines = lines.withColumns({"n": F.row_number().over(w), "before": F.lag("category").over(w), "culprit": culprit(F.col("source"), F.col("line")), "file": F.regexp_extract("path", r"[^/\\\\]*$", 0)})
    head = F.when(F.col("category").eqNullSafe(F.col("before")), "").otherwise(F.concat(F.when(F.col("before").isNull(), "").otherwise("\n\n"), F.upper("category"), F.lit(":\n\n")))
    body = F.format_string("  %s  %s  L%d  %s:%d\n      %s\n", "code", "severity", "line", "file", "line", "message")
    seen = F.when(F.length(F.trim("culprit")) > 0, F.format_string("      %d | %s\n", "line", "culprit")).otherwise("")
    shown = F.concat(head, body, seen, F.lit("\n"))
    some = lines.select("path", "n", shown.alias("shown")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda r: r["shown"]), "").alias("rendered"))
    return files.select("path").join(some, "path", "left").withColumn("rendered", F.coalesce("rendered", F.lit("Check complete, good code!\n")))


def clean_first(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, n): clean files by path, then dirty ones by path."""
    each = findings.groupBy("path").agg(F.count("*").alias("n"))
    return files.select("path").join(each, "path", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.col("n") > 0, "path")


def clean_first_places(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, n, place): the place of every file in that order."""
    each = findings.groupBy("path").agg(F.count("*").alias("n"))
    rows = files.select("path").join(each, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    return numbered(rows.withColumn("_dirty", F.col("n") > 0), "place", "_dirty", "path").drop("_dirty")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place from 1 on in that order, by ranges: each range is sorted by itself and begins where those before it end.

    What is put together for the borders is one number for each range."""
    ranges = rows.repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("_range", F.spark_partition_id())
    ranges = keep_table(ranges, "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(name, (place + F.col("_before")).cast("long")).drop("_range", "_before")


def exit_code(files: DataFrame) -> int:
    """1 if any file cannot be reviewed, else 0."""
    return int(not errors(files).isEmpty())


def diagnostics(findings: DataFrame) -> DataFrame:
    """Editor diagnostics: zero-based lines, a fixed range of columns, the editor's severities."""
    level = F.when(F.col("severity") == "WARNING", "Warning").when(F.col("severity") == "INFO", "Information").otherwise("Hint")
    return findings.select("path", F.greatest(F.col("line") - 1, F.lit(0)).alias("line"), F.lit(0).alias("from_column"), F.lit(1000).alias("to_column"), level.alias("level"), "message", "code", F.lit("verdigris").alias("source"))


def hyperlink(uri: str, text: str) -> str:
    """text as a terminal's link (OSC 8) to uri."""
    return f"\033]8;;{uri}\033\\{text}\033]8;;\033\\"


def links(findings: DataFrame, editor: bool = False) -> DataFrame:
    """findings with the link that opens them."""
    uri = F.concat(F.lit("vscode://file"), "path", F.lit(":"), "line") if editor else F.concat(F.lit("file://"), "path")
    return findings.withColumn("uri", uri)


def write_json(files: DataFrame, findings: DataFrame, path: str) -> None:
    reports(files, findings).write.mode("overwrite").json(path)


def export_lines(findings: DataFrame) -> DataFrame:
    """(path, value): what the exported text file says of each file with findings."""
    row = F.struct("line", "category", "code", *ORDER, F.format_string("  %s %s L%d: %s", "code", "severity", "line", "message").alias("shown"))
    return findings.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["shown"]).alias("rows")).select("path", F.concat(F.lit("── "), "path", F.lit(" ──\n"), F.array_join("rows", "\n"), F.lit("\n")).alias("value"))


def write_text(findings: DataFrame, path: str) -> None:
    """The exported text, by path."""
    export_lines(findings).orderBy("path").select("value").write.mode("overwrite").text(path)


def write_one_text(findings: DataFrame, path: str) -> None:
    """The exported text as one file of this machine, by path, row after row."""
    with open(path, "w", encoding="utf-8") as out:
        for row in export_lines(findings).orderBy("path").select("value").toLocalIterator():
            out.write(row["value"] + "\n")


def summary_text(row) -> str:
    """The printed summary of summary()'s row."""
    out = ["", "── Summary ──", f"  Files reviewed : {row['reviewed']}", f"  Clean files   : {row['clean']}", f"  Files with issues: {row['dirty']}", f"  Suggestions   : {row['suggestions']}", f"  Warnings      : {row['warnings']}"]
    return "\n".join([*out, f"  Info          : {row['info']}"] if row["info"] else out)
