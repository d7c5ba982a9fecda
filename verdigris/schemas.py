"""Schemas of the review engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _row(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, B = StringType(), IntegerType(), BooleanType()
PAIR = _row(("seq", S), ("idx", S))
WRITE = _row(("attr", S), ("line", I))
STMT = _row(("line", I), ("end_line", I), ("shape", S), ("run", I), ("pos", I))
METHOD = _row(("key", S), ("ord", I), ("cls", S), ("name", S), ("line", I))

FILES = _row(("path", S), ("source", S), ("mtime", TimestampType()))

#: One row for each syntax node that a rule can look at. ``kind`` is the node's class; columns that do not apply are null.
FACTS = _row(
    ("kind", S), ("bfs", I), ("pre", I), ("line", I), ("end_line", I), ("name", S),
    # context
    ("fn_depth", I), ("try_depth", I), ("type_checking_depth", I), ("in_with", B), ("depth", I), ("test_module", B),
    # comparisons, operators, calls, subscripts
    ("none_equality", B), ("op", S), ("left_str", B), ("right_str", B),
    ("call_form", S), ("call_owner", S), ("n_args", I), ("lambda_args", ArrayType(I)), ("slice_form", S),
    # loops
    ("n_body", I), ("append_base", S), ("range_len", B), ("target", S), ("subscripts", ArrayType(PAIR)), ("concat_base", S),
    ("scope_lists", ArrayType(S)), ("scope_strs", ArrayType(S)), ("body_returns", S), ("body_else", B), ("next_returns", S),
    # conditions
    ("container", S), ("member", S), ("has_else", B), ("body_append", B), ("else_assign", B),
    # classes and functions
    ("is_dataclass", B), ("n_attrs", I), ("n_methods", I), ("n_plain_methods", I), ("span", I), ("writes", ArrayType(WRITE)), ("reads", ArrayType(S)),
    ("stmts", ArrayType(STMT)), ("decorated", B), ("outer_passed", ArrayType(S)), ("n_params", I), ("methods", ArrayType(METHOD)), ("imported", S),
    ("error", S),
)

FINDING = _row(("code", S), ("category", S), ("severity", S), ("message", S), ("line", I), ("column", I), ("end_line", I))
FINDINGS = StructType([StructField("path", S), *FINDING.fields])
SUPPRESSIONS = _row(("path", S), ("line", I), ("code", S))
SUGGESTION = _row(("line", I), ("message", S), ("severity", S))
#: Symbols of a file: kind is chunk, import, base or module.
SYMBOLS = _row(("kind", S), ("ord", I), ("symbol", S), ("chunk_kind", S), ("signature", S), ("docstring", S), ("body", S), ("target", S))
#: Usage events; no source text.
EVENTS = _row(
    ("ts", TimestampType()), ("event", S), ("session_id", S), ("mode", S), ("target_type", S), ("target", S), ("language", S), ("lines", I),
    ("issues", ArrayType(_row(("rule", S), ("severity", S)))), ("latency_ms", DoubleType()), ("accepted", ArrayType(I)), ("version", S),
)
SEQ = LongType()
