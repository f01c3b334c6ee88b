"""Stable identifiers: shortened SHA-256 of the identifying fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finding_id(rule: Column, path: Column, line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rule, path, line.cast("string")), 256), 1, 16)


def external_id(tool: Column, rule: Column, path: Column, line: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", tool, rule, path, line.cast("string"), title), 256), 1, 16)


def root_cause_id(rule: Column, sink: Column, source: Column, callee: Column) -> Column:
    empty = F.lit("")
    key = F.concat_ws("|", rule, F.coalesce(sink, empty), F.coalesce(source, empty), F.coalesce(callee, empty))
    return F.concat(F.lit("RC-"), F.upper(F.substring(F.sha2(key, 256), 1, 12)))
