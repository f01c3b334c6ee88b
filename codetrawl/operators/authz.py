"""Sensitive Python functions without an observable authorization control.

What a function is, and where it ends, is what Python's own parser says: strings over several lines, decorators, one-line
bodies and continuation lines need no rules here, and a file that does not parse has no functions. Only files in which a
sensitive name is declared are handed to the parser, their text alone and a batch at a time; it gives back the lines of
the functions in question. Everything else, evidence included, stays with the table of files, so there is no shuffle.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import paths
from ..functions import text as tx
from ..functions.sqltext import lit
from . import rules

_SENSITIVE_FILE = r"(?i)def\s+\w*(?:delete|update|admin|transfer|password|login)"
_FOUND = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("function", T.StringType())]))
_FOUND_ARROW = pa.list_(pa.struct([("line_no", pa.int32()), ("function", pa.string())]))
_LINE = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_NAME = re.compile(fv.AUTHZ_FUNCTION_NAME)
_MARKERS = [m.encode() for m in fv.AUTHZ_MARKERS]


def _functions(tree: ast.Module) -> Iterator[ast.FunctionDef | ast.AsyncFunctionDef]:
    """All functions of a file, outer ones first. They stand in statements only, so expressions are not walked through."""
    waiting = deque(tree.body)
    while waiting:
        node = waiting.popleft()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node
        for name in ("body", "handlers", "cases", "orelse", "finalbody"):
            waiting.extend(getattr(node, name, ()))


def uncontrolled(text: str) -> list[dict]:
    """Line and name of each sensitive function whose source, decorators aside, names no control."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines: list[bytes] | None = None
    found = []
    for node in _functions(tree):
        if not _NAME.search(node.name):
            continue
        # places within a line are counted in bytes
        lines = lines if lines is not None else _LINE.findall(text.encode())
        own = lines[node.lineno - 1:node.end_lineno]
        own[-1] = own[-1][:node.end_col_offset]
        own[0] = own[0][node.col_offset:]
        source = b"".join(own).decode().lower().encode()
        if not any(m in source for m in _MARKERS):
            found.append({"line_no": node.lineno, "function": node.name})
    return found


@F.arrow_udf(_FOUND)
def _uncontrolled(texts: pa.Array) -> pa.Array:
    # one text at a time: a batch is limited to some bytes by Spark, but its texts and trees as Python objects are several times that
    return pa.array([[] if not text.is_valid else uncontrolled(text.as_py()) for text in texts], _FOUND_ARROW)


def functions_without_control(files: DataFrame, snippet_lines: int = fv.SNIPPET_LINES, snippets: bool = True,
                              hide: bool = True) -> DataFrame:
    """(repo, path, code_surface, line_no, function, evidence) of the functions in question."""
    python = files.filter((F.col("language") == "python") & tx.matches(F.col("text"), _SENSITIVE_FILE))
    judged = python.select("repo", "path", "code_surface", "text", _uncontrolled(F.col("text")).alias("found"))
    # a file without such functions ends with its empty list; a filter would be pushed below, where it parses every file once more
    lines = tx.split_lines(tx.normal_breaks(F.col("text"))).alias("raw_lines")
    line_no = F.col("item.line_no")
    return (
        judged.select("repo", "path", "code_surface", lines, "found")
        # evidence is cut where the array is at hand, not behind the explosion
        .select("repo", "path", "code_surface", F.explode(F.transform("found", lambda f: F.struct(
            f.line_no.alias("line_no"), f.function.alias("function"),
            tx.snippet(F.col("raw_lines"), f.line_no, snippet_lines, snippets, hide).alias("evidence")))).alias("item"))
        .select("repo", "path", "code_surface", line_no, "item.function", "item.evidence")
    )


def to_findings(functions: DataFrame, framework: str | None = None) -> DataFrame:
    rule_id, title, category, severity, confidence = fv.AUTHZ_RULE[1:]

    def text(value: str) -> str:
        return lit(value).text

    surface = "if(code_surface <> 'unknown', code_surface, path_surface)"
    return functions.withColumn("path_surface", paths.surface_of(F.col("path"))).selectExpr(*rules.finding_columns(dict(
        repo="repo", id=f"substring(sha2(concat_ws(':', {text(rule_id)}, path, line_no), 256), 1, 16)",
        rule_id=text(rule_id), title=text(title), description=text(title), category=text(category),
        subcategory="'secure-coding'", language="'python'", classification="'review_lead'",
        framework="null" if framework is None else text(framework),
        confidence_score=str(confidence), suggested_severity=text(severity),
        verdict_candidate="'secure_coding_concern'", file_path="path", start_line="line_no", end_line="line_no",
        function="function", missing_or_questionable_controls=f"array({text(fv.AUTHZ_MISSING)})",
        recommended_verification_steps=f"array({text(fv.AUTHZ_VERIFY)})",
        recommended_remediation=text(fv.AUTHZ_REMEDIATION), analyzer="'python.ast'", parser_used="'python.ast'",
        evidence="evidence", code_surface=surface, test_surface=f"{surface} = 'test'",
        emit_seq="named_struct('origin', 0, 'file', path, 'phase', 1, 'pos', cast(line_no as bigint), 'ord', 0)",
    )))
