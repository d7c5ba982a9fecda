"""Column functions over source text, model output and vectors; all of them run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of suppression comments and line borders.
NOQA = r"#\s*noqa(?::\s*([A-Z]+\d+(?:\s*,\s*[A-Z]+\d+)*))?\b"
LINE_BORDERS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
MAX_SUGGESTIONS = 5


def source_lines(source: Column) -> Column:
    """The lines of a text; a border at its end begins no line."""
    lines = F.split(source, LINE_BORDERS, -1)
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def noqa_codes(line: Column) -> Column:
    """The codes that a line's first suppression comment names: [null] for a bare one, null without a comment."""
    codes = F.regexp_extract(line, NOQA, 1)
    named = F.transform(F.split(codes, ","), lambda x: F.trim(x))
    bare = F.array(F.lit(None).cast("string"))
    return F.when(F.regexp_like(line, F.lit(NOQA)), F.when(codes != "", named).otherwise(bare))


def noqa_rows(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keep, line, code) of every suppression; a null code is any."""
    lines = files.where(F.contains(F.col("source"), F.lit("noqa"))).select(*keep, F.posexplode(source_lines(F.col("source"))).alias("at", "text"))
    found = lines.where(F.contains(F.col("text"), F.lit("noqa"))).select(*keep, (F.col("at") + 1).cast("int").alias("line"), noqa_codes(F.col("text")).alias("codes"))
    return found.select(*keep, "line", F.explode("codes").alias("code"))


def text_shape(text: Column) -> Column:
    """Words as N, digits as C, white space as blanks, for ASCII texts."""
    words = F.regexp_replace(text, r"[A-Za-z_][A-Za-z0-9_]*", "N")
    return F.trim(F.regexp_replace(F.regexp_replace(words, r"[0-9]+", "C"), r"\s", " "))


def module_name(path: Column) -> Column:
    """The dotted module of a root-relative path."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.replace(F.when(F.endswith(p, F.lit("/__init__.py")), F.regexp_replace(p, r"/__init__\.py$", "")).otherwise(F.regexp_replace(p, r"\.py$", "")), F.lit("/"), F.lit("."))


def prefixes(dotted: Column, separator: str = ".") -> Column:
    """(prefix, depth) structs of a dotted name, the longest first."""
    parts = F.split(dotted, re.escape(separator))
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), separator).alias("prefix"), n.alias("depth")))


def blank_lines(source: Column, hidden: Column) -> Column:
    """source with the lines of these numbers (array<int>) emptied; unchanged if there are none."""
    lines = F.transform(source_lines(source), lambda x, i: F.when(F.array_contains(hidden, (i + 1).cast("int")), F.lit("")).otherwise(x))
    return F.when(F.size(hidden) > 0, F.array_join(lines, "\n")).otherwise(source)


def json_object(content: Column) -> Column:
    """The outermost braces of a text without its code fence, with trailing commas gone."""
    t = F.trim(F.regexp_replace(content, r"^\s+|\s+$", ""))
    fenced = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    t = F.when(F.startswith(t, F.lit("```")), fenced).otherwise(t)
    start, end = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    cut = F.when((start > 0) & F.contains(t, F.lit("}")) & (end > start), F.substring(t, start, end - start + 1)).otherwise(t)
    return F.regexp_replace(cut, r",\s*([}\]])", "$1")


def severity_of(value: Column) -> Column:
    u = F.upper(value)
    return F.when(u.isin("INFO", "SUGGESTION", "WARNING"), u).otherwise("SUGGESTION")


def response_content(response: Column) -> Column:
    """The answer's text in a chat response, null if it has none."""
    return F.get_json_object(response, "$.choices[0].message.content")


#: An object up to its end, the next object, or the end of a text that was cut off; its strings may hold braces.
OBJECT = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*+"?)*+'
NUMBER_OF, STRING_OF = r'"{}"\s*:\s*(\d+)', r'"{}"\s*:\s*("(?:[^"\\]|\\.)*+")'


def salvage_messages(content: Column) -> Column:
    """Suggestion objects in broken JSON, in order, their fields in any order; a string must be whole, its escapes are decoded."""

    def string(x: Column, name: str) -> Column:
        found = F.regexp_extract(x, STRING_OF.replace("{}", name), 1)
        plain = F.regexp_replace(F.regexp_replace(found, "\r", "\\\\r"), "\n", "\\\\n")
        decoded = F.get_json_object(F.concat(F.lit('{"v":'), plain, F.lit("}")), "$.v")
        return F.when(found != "", F.coalesce(decoded, F.substring(found, 2, F.length(found) - 2)))

    def item(x: Column) -> Column:
        line = F.regexp_extract(x, NUMBER_OF.replace("{}", "line"), 1).try_cast("int")
        message = F.regexp_replace(string(x, "message"), r"^\s+|\s+$", "")
        return F.when(line.isNotNull() & (F.length(message) > 0), F.struct(line.alias("line"), message.alias("message"), string(x, "severity").alias("severity")))

    objects = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(OBJECT), F.lit(0))
    return F.filter(F.transform(objects, item), lambda x: x.isNotNull())


def raw_suggestions(content: Column) -> Column:
    """The first items of a model's answer as structs of line, message and severity; items of other shape are null.

    A line must be a whole JSON number or a truth value, a message a string: nothing is coerced."""
    items = F.expr("try_variant_get(_json, '$.suggestions', 'array<variant>')")
    first = F.slice(items, 1, MAX_SUGGESTIONS)

    def item(v: Column) -> Column:
        line, message = F.try_variant_get(v, "$.line", "variant"), F.try_variant_get(v, "$.message", "variant")
        kind = F.schema_of_variant(line)
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$.line", "boolean").cast("int")).when(kind == "BIGINT", F.try_variant_get(v, "$.line", "int"))
        text = F.when(F.schema_of_variant(message) == "STRING", F.regexp_replace(F.try_variant_get(v, "$.message", "string"), r"^\s+|\s+$", ""))
        good = number.isNotNull() & (F.length(text) > 0)
        return F.when(good, F.struct(number.alias("line"), text.alias("message"), severity_of(F.try_variant_get(v, "$.severity", "string")).alias("severity")))

    return F.filter(F.transform(first, item), lambda x: x.isNotNull())


def parse_suggestions(responses: DataFrame, content: str = "content") -> DataFrame:
    """responses with suggestions, an array of line, message and severity: strict JSON first, else what can be salvaged.

    The first items count before they are checked; salvaged ones are capped by the caller after its checks."""
    t = responses.withColumn("_json", F.try_parse_json(json_object(F.col(content))))
    strict = F.coalesce(raw_suggestions(F.col(content)), F.array().cast("array<struct<line:int,message:string,severity:string>>"))
    salvaged = F.transform(salvage_messages(F.col(content)), lambda x: F.struct(x["line"].alias("line"), x["message"].alias("message"), severity_of(x["severity"]).alias("severity")))
    ok = F.col("_json").isNotNull()
    return t.withColumns({"salvaged": ~ok, "suggestions": F.when(ok, strict).otherwise(salvaged)}).drop("_json")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if a norm is 0; different lengths are an error."""
    same = F.assert_true(F.size(a) == F.size(b), "vectors of different lengths")
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(same.isNull(), F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def centroid(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid, n): element-wise means; partial sums are made before the shuffle."""
    parts = vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda r: r["mean"]).alias("centroid"), F.max("n").alias("n"))
