"""Steps between raw matches and the findings table; each is DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import fixed_values as fv
from ..options import ScanOptions

KEY = ("repo", "rule_id", "file_path", "start_line")


def language_filter(files: DataFrame, languages) -> DataFrame:
    """Files of the wanted languages; applied before any line is looked at."""
    return files.filter(F.col("language").isin(*languages)) if languages else files


def _with(df: DataFrame, **expressions: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})


def rule_family(df: DataFrame) -> DataFrame:
    return _with(df, rule_family=r"coalesce(get(split(rule_id, '\\.'), 1), rule_id)")


def parser_label(df: DataFrame) -> DataFrame:
    """Python findings carry the label of the module parser."""
    return _with(df, parser_used="if(language = 'python', 'python.ast', parser_used)",
                 syntax_node_type="if(language = 'python', 'Module', syntax_node_type)")


def surface_flags(df: DataFrame) -> DataFrame:
    return _with(df, test_only="code_surface = 'test'",
                 production_reachability="if(code_surface = 'test', 'test_only', 'production')")


def detected(df: DataFrame) -> DataFrame:
    return _with(df, source_detected="coalesce(source, '') <> ''", sink_detected="coalesce(sink, '') <> ''")


def flow(df: DataFrame) -> DataFrame:
    partial = "source_detected and sink_detected and invocation_detected"
    return _with(
        df, flow_status=f"case when {partial} then 'partial' "
                        "when sink_detected or invocation_detected then 'sink_only' else 'unresolved' end",
        evidence_level=f"if({partial}, 2, 0)")


def downgrade(df: DataFrame) -> DataFrame:
    """A review lead of which only the sink is seen becomes an informational review point."""
    lower = "flow_status = 'sink_only' and classification = 'review_lead'"
    return _with(
        df, verdict_candidate=f"if({lower}, 'review_point', verdict_candidate)",
        suggested_severity=f"if({lower}, 'informational', suggested_severity)",
        cwe_ids=f"if({lower}, cast(array() as array<string>), cwe_ids)",
        classification=f"if({lower}, 'review_point', classification)")


def score(df: DataFrame) -> DataFrame:
    return _with(
        df, evidence_score="least(100, confidence_score)",
        evidence_completeness="map('source_identified', source_detected, 'sink_identified', sink_detected, "
                              "'actual_invocation_confirmed', invocation_detected, 'production_surface', "
                              "not test_only, 'runtime_dependency_remaining', size(proof_gaps) > 0)")


STEPS = (rule_family, parser_label, surface_flags, detected, flow, downgrade, score)


def enrich(df: DataFrame) -> DataFrame:
    columns = df.columns
    return reduce(lambda frame, step: frame.transform(step), STEPS, df).select(*columns)


# --- filters ------------------------------------------------------------------------


_SECRET_RULE = "WB.SECRET.HARDCODED"


def test_code(df: DataFrame, options: ScanOptions) -> DataFrame:
    """Findings in test code stay, stay if they are secrets, or go."""
    if options.kept.test_code == "all":
        return df
    outside = ~F.col("test_only")
    return df.filter(outside | (F.col("rule_id") == _SECRET_RULE) if options.kept.test_code == "secrets" else outside)


def verdicts(df: DataFrame, options: ScanOptions) -> DataFrame:
    wanted = options.kept.verdicts
    return df.filter(F.col("verdict_candidate").isin(*wanted)) if wanted else df


def evidence(df: DataFrame, options: ScanOptions) -> DataFrame:
    return df.filter(F.col("evidence_level") >= options.kept.evidence) if options.kept.evidence > 0 else df


def severities(df: DataFrame, options: ScanOptions) -> DataFrame:
    wanted = options.kept.severities
    return df.filter(F.col("suggested_severity").isin(*wanted)) if wanted else df


def confidence(df: DataFrame, options: ScanOptions) -> DataFrame:
    return df.filter(F.col("confidence_score") >= options.kept.confidence) if options.kept.confidence > 0 else df


# filters that depend on the rule variant alone, and those that depend on the file as well
VARIANT_FILTERS = (verdicts, evidence, severities, confidence)
FILE_FILTERS = (test_code,)


def apply_filters(df: DataFrame, options: ScanOptions, filters=FILE_FILTERS + VARIANT_FILTERS) -> DataFrame:
    return reduce(lambda frame, step: step(frame, options), filters, df)


def nominal_filters(df: DataFrame, options: ScanOptions) -> DataFrame:
    """What a report shows: all but the hidden verdicts."""
    hidden = options.kept.hidden
    return df.filter(~F.col("verdict_candidate").isin(*hidden)) if hidden else df


def framework_filter(frameworks: DataFrame, names) -> DataFrame:
    """(repo, framework) rows restricted to the named frameworks."""
    return frameworks.filter(F.col("framework").isin(*names)) if names else frameworks


def with_framework(findings: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Findings of generic rules get the alphabetically first framework of their repository."""
    first = frameworks.groupBy("repo").agg(F.min("framework").alias("_framework"))
    generic = F.col("analyzer").endswith(".lexical") & ~F.col("analyzer").contains("aware")
    return (
        findings.join(first, "repo", "left")
        .withColumn("framework", F.when(generic, F.col("_framework")).otherwise(F.col("framework")))
        .select(*findings.columns)
    )


# --- dedup -----------------------------------------------------------------------------


def dedup(findings: DataFrame, key=KEY) -> DataFrame:
    """One finding per key: the last one emitted, at the place of the first."""
    by_key = Window.partitionBy(*key)
    ranked = findings.withColumns({
        "_rank": F.row_number().over(by_key.orderBy(F.col("emit_seq").desc())),
        "_first": F.min("emit_seq").over(by_key),
    })
    return ranked.filter(F.col("_rank") == 1).withColumn("emit_seq", F.col("_first")).select(*findings.columns)


# --- status flags ------------------------------------------------------------------------


def any_of(findings: DataFrame, condition: Column, name: str) -> DataFrame:
    """One row: whether any finding meets the condition."""
    return findings.agg(F.coalesce(F.max(F.when(condition, F.lit(1))), F.lit(0)).cast("boolean").alias(name))


def fail_on(findings: DataFrame, severity: str) -> DataFrame:
    return any_of(findings, F.col("suggested_severity").isin(severity, "critical"), "failed")


def review_exit(findings: DataFrame) -> DataFrame:
    return any_of(findings, F.col("verdict_candidate").isin(*fv.CANDIDATE_VERDICTS), "has_candidates")
