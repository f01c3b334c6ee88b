"""Root causes, summaries and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import ids


def with_root_cause(findings: DataFrame) -> DataFrame:
    root = ids.root_cause_id(F.col("rule_id"), F.col("sink"), F.col("source"), F.get("related_callees", F.lit(0)))
    return findings.withColumns({"root_cause_id": root, "instance_of": root})


def _distinct(column: str):
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(column))))


def root_causes(findings: DataFrame) -> DataFrame:
    """One row per repository and root cause, described by its first finding.

    Aggregated map-side first, so a root cause that owns a third of all findings reaches the
    reducer as one row per map task. Its member ids are in ``root_cause_instances``.
    """
    first = F.min_by(
        F.struct("title", "verdict_candidate", "file_path", "start_line", "sink",
                 F.get("related_callees", F.lit(0)).alias("callee")),
        "emit_seq",
    )
    grouped = findings.groupBy("repo", "root_cause_id").agg(
        first.alias("first"),
        F.count("*").alias("instance_count"),
        _distinct("related_routes").alias("related_routes"),
        _distinct("proof_gaps").alias("proof_gaps"),
        _distinct("counterevidence").alias("counterevidence"),
    )
    return grouped.select(
        "repo", "root_cause_id",
        F.col("first.title").alias("title"),
        F.col("first.verdict_candidate").alias("root_cause_type"),
        "instance_count",
        F.struct(F.col("first.file_path").alias("file_path"), F.col("first.start_line").alias("line"))
        .alias("canonical_location"),
        F.coalesce(F.col("first.sink"), F.lit("")).alias("shared_sink"),
        F.coalesce(F.col("first.callee"), F.lit("")).alias("shared_callee"),
        "related_routes", "proof_gaps", "counterevidence",
    )


def root_cause_instances(findings: DataFrame) -> DataFrame:
    """Finding ids of a root cause, in emission order within each file.

    One row per root cause and file: files are bounded in size, root causes are not.
    Ordered by (origin, file), the rows spell out the full instance list.
    """
    rows = F.sort_array(F.collect_list(F.struct("emit_seq", "id")))
    return findings.groupBy(
        "repo", "root_cause_id", F.col("emit_seq.origin").alias("origin"), "file_path"
    ).agg(F.transform(rows, lambda r: r["id"]).alias("instances"), F.count("*").alias("instance_count"))


def summaries(findings: DataFrame) -> DataFrame:
    """One row of counts over findings and root causes."""
    verdict, status = F.col("verdict_candidate"), F.col("flow_status")
    per_root = findings.groupBy("repo", "root_cause_id").agg(
        F.count("*").alias("instances"),
        F.count_if(verdict.isin(*fv.CANDIDATE_VERDICTS)).alias("candidate_findings"),
        F.count_if(verdict.isin(*fv.REVIEW_VERDICTS)).alias("review_points"),
        F.count_if("test_only").alias("test_only_items"),
        F.count_if(verdict == "suppressed").alias("suppressed_results"),
        F.count_if(status == "complete").alias("complete_flows"),
        F.count_if(status == "partial").alias("partial_flows"),
        F.count_if(status == "sink_only").alias("sink_only"),
    )
    names = [c for c in per_root.columns if c not in ("repo", "root_cause_id")]
    return per_root.agg(
        F.count("*").alias("root_causes"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    )


def report_counts(findings: DataFrame) -> DataFrame:
    """Counts of the report header. Leads are all but review points and suppressed results."""
    verdict = F.col("verdict_candidate")
    per_root = findings.groupBy("repo", "root_cause_id").agg(
        F.count("*").alias("instances"),
        F.count_if(~verdict.isin(*fv.REVIEW_VERDICTS, "suppressed")).alias("review_leads"),
        F.count_if(verdict.isin(*fv.REVIEW_VERDICTS)).alias("review_points"),
    )
    return per_root.agg(
        F.count("*").alias("root_causes"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("instances", "review_leads", "review_points")],
    )


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def scan_counts(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: files scanned and entries skipped."""
    counted = files.agg(F.count("*").alias("files_scanned")).crossJoin(
        skipped.agg(F.count("*").alias("files_skipped"))
    )
    return counted


def stdout_summary(files: DataFrame, findings: DataFrame, target: str) -> DataFrame:
    """One JSON record: target, file and finding counts, summaries."""
    counts = summaries(findings)
    one = files.agg(F.count("*").alias("files")).crossJoin(counts)
    return one.select(
        F.to_json(F.struct(F.lit(target).alias("target"), "files", F.col("instances").alias("findings"),
                           *counts.columns)).alias("summary")
    )
