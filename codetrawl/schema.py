"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

from . import fixed_values as fv

_STR = T.StringType()
_INT = T.IntegerType()
_BOOL = T.BooleanType()
_LIST = T.ArrayType(_STR)

SOURCE_FILES = T.StructType([
    T.StructField("repo", _STR),
    T.StructField("path", _STR),
    T.StructField("language", _STR),
    T.StructField("text", _STR),
    T.StructField("size", T.LongType()),
    T.StructField("code_surface", _STR),
])

# What a raw file listing has to carry; content is null for files that were not read.
RAW_FILES = T.StructType([
    T.StructField("repo", _STR),
    T.StructField("path", _STR),
    T.StructField("size", T.LongType()),
    T.StructField("is_symlink", _BOOL),
    T.StructField("error", _STR),
    T.StructField("content", T.BinaryType()),
])

# (name, type, default) of a finding, in column order.
_FINDING = [
    ("id", _STR, None), ("rule_id", _STR, None), ("title", _STR, None), ("description", _STR, None),
    ("category", _STR, None), ("subcategory", _STR, None), ("language", _STR, None),
    ("framework", _STR, None), ("classification", _STR, "review_lead"), ("confidence_score", _INT, 0),
    ("suggested_severity", _STR, "informational"), ("cwe_ids", _LIST, ()), ("owasp_categories", _LIST, ()),
    ("file_path", _STR, ""), ("start_line", _INT, 1), ("end_line", _INT, 1), ("function", _STR, None),
    ("class_name", _STR, None), ("route", _STR, None), ("source", _STR, None), ("sink", _STR, None),
    ("data_flow", _LIST, ()), ("observed_controls", _LIST, ()),
    ("missing_or_questionable_controls", _LIST, ()), ("attacker_requirements", _LIST, ()),
    ("preconditions", _LIST, ()), ("potential_impact", _STR, fv.DEFAULT_IMPACT), ("evidence", _STR, ""),
    ("false_positive_conditions", _LIST, ()), ("recommended_verification_steps", _LIST, ()),
    ("recommended_remediation", _STR, fv.DEFAULT_REMEDIATION), ("analyzer", _STR, "generic"),
    ("external_tool", _STR, None), ("external_rule_id", _STR, None), ("verification_status", _STR, "pending"),
    ("verification_notes", _STR, ""), ("confirmed_severity", _STR, None), ("false_positive_reason", _STR, None),
    ("remediation_status", _STR, "open"), ("verdict_candidate", _STR, "cannot_determine"),
    ("code_surface", _STR, "unknown"), ("reachability", _STR, "unknown"), ("transformations", _LIST, ()),
    ("proof_gaps", _LIST, ()), ("counterevidence", _LIST, ()), ("parser_used", _STR, "lexical"),
    ("syntax_node_type", _STR, None), ("invocation_detected", _BOOL, False), ("declaration_detected", _BOOL, False),
    ("comment_context", _STR, "active_code"), ("test_surface", _BOOL, False), ("exact_invoked_api", _STR, None),
    ("related_routes", _LIST, ()), ("related_callers", _LIST, ()), ("related_callees", _LIST, ()),
    ("sensitive_value", _STR, None), ("logging_sink", _STR, None), ("masking_detected", _BOOL, False),
    ("redaction_detected", _BOOL, False), ("structured_logging", _BOOL, False), ("missing_controls", _LIST, ()),
    ("rule_family", _STR, None), ("matched_construct", _STR, None), ("source_detected", _BOOL, False),
    ("sink_detected", _BOOL, False), ("flow_status", _STR, "unresolved"), ("controls_checked", _LIST, ()),
    ("elevation_reason", _STR, ""), ("suppression_reason", _STR, None), ("cwe_mapping_reason", _STR, ""),
    ("evidence_level", _INT, 0), ("evidence_score", _INT, 0),
    ("evidence_completeness", T.MapType(_STR, _BOOL), {}), ("production_reachability", _STR, "unknown"),
    ("test_only", _BOOL, False), ("generated", _BOOL, False), ("demo", _BOOL, False), ("utility", _BOOL, False),
    ("configuration", _BOOL, False), ("migration", _BOOL, False), ("root_cause_id", _STR, None),
    ("instance_of", _STR, None),
]
# Position of a finding in the order in which a single-threaded scan would emit it.
EMIT_SEQ = T.StructType([
    T.StructField("origin", _INT),   # 0 = rules, 1 = imported results
    T.StructField("file", _STR),
    T.StructField("phase", _INT),    # 0 = line rules, 1 = function rule
    T.StructField("pos", T.LongType()),
    T.StructField("ord", _INT),
])

FINDING_DEFAULTS = {name: default for name, _, default in _FINDING}
FINDINGS = T.StructType(
    [T.StructField("repo", _STR)]
    + [T.StructField(name, kind) for name, kind, _ in _FINDING]
    + [T.StructField("emit_seq", EMIT_SEQ)]
)
