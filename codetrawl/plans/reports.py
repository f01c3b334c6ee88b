"""Sinks: the tables a scan leaves behind, as data, SARIF records and report rows.

Report text is a rendering job: one formatted block per finding with its sort columns. ``documents`` puts the pieces of a
repository in order and writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import compare, correlate


def _or(column: Column, default: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def _joined(column: str, default: str) -> Column:
    return _or(F.array_join(column, ", "), default)


def _is_review() -> Column:
    return F.col("verdict_candidate").isin(*fv.REVIEW_VERDICTS)


def review_points(findings: DataFrame) -> DataFrame:
    return findings.filter(_is_review())


def woven(frame: str, first, second) -> Column:
    """The three texts of a frame, which many findings share, with a finding's own two texts between them; null without a frame."""
    return F.concat(F.get(frame, F.lit(0)), first, F.get(frame, F.lit(1)), second, F.get(frame, F.lit(2)))


def frame_keys(*columns, lists: tuple[str, ...] = ()) -> list[Column]:
    """128 bits of the values that a frame is made of; which of them, or of the items of ``lists``, are null counts, as hashes pass over nulls."""
    values = [*columns, *[F.isnull(c) for c in columns], *[F.transform(c, F.isnull) for c in lists]]
    return [F.xxhash64(*values).alias("f1"), F.xxhash64(F.lit(1), *values).alias("f2")]


def location() -> Column:
    return F.concat_ws(":", "file_path", F.col("start_line").cast("string"))


def finding_records(findings: DataFrame) -> DataFrame:
    """One JSON record per finding, fields in alphabetical order, with its sort columns."""
    names = sorted(c for c in findings.columns if c not in ("emit_seq", "repo"))
    record = F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})
    return findings.select("repo", "emit_seq", record.alias("value"))


def _sarif_fields() -> dict[str, Column]:
    """The fields of a SARIF result; locations, the last one, are a finding's own."""
    level = F.when(F.col("suggested_severity").isin("high", "critical"), F.lit("error")).otherwise(F.lit("warning"))
    return {
        "ruleId": F.col("rule_id"),
        "level": level,
        "message": F.struct(F.concat_ws(": ", "title", "description").alias("text")),
        "properties": F.struct("verdict_candidate", "code_surface", "source", "sink", "data_flow", "proof_gaps",
                               "counterevidence", "parser_used", "exact_invoked_api"),
        "locations": F.array(F.struct(F.struct(
            F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region"),
        ).alias("physicalLocation"))),
    }


def sarif_results(findings: DataFrame) -> DataFrame:
    """The fields of one SARIF result per finding."""
    return findings.select("repo", "emit_seq", *[field.alias(name) for name, field in _sarif_fields().items()])


def sarif_records(findings: DataFrame) -> DataFrame:
    """One SARIF result as JSON per row; the log is this stream of results per repository."""
    rows = sarif_results(findings)
    fields = [F.col(c) for c in rows.columns if c not in ("repo", "emit_seq")]
    return rows.select("repo", "emit_seq",
                       F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


SARIF_END = "]}]}"
# a table with a row for each of so many repositories is sent to every task
MOST_REPOS = 100_000


def sarif_head(tool: str, version: str) -> Column:
    """The text of a log before its first result."""
    return F.concat(
        F.lit(f'{{"$schema":"{fv.SARIF_SCHEMA}","version":"{fv.SARIF_VERSION}","runs":[{{"tool":{{"driver":'),
        F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"))),
        F.lit('},"results":['),
    )


def sarif_parts(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """(repo, part, emit_seq, first, value, frame, f1, f2): pieces that make one SARIF log per repository in order.

    Opening and closing text are rows of their own, so no repository's results are gathered
    into one cell; the per-repository row that says which result comes first is small. Results have frames, into which
    ``first``, the comma, and their locations go.
    """
    firsts = findings.groupBy("repo").agg(F.min("emit_seq").alias("first_seq"))
    # the results stay where they lie unless repositories are very many
    met = F.broadcast(firsts) if firsts.limit(MOST_REPOS + 1).count() <= MOST_REPOS else firsts
    *shared, own = [field.alias(name) for name, field in _sarif_fields().items()]
    record, locations = (F.to_json(x, {"ignoreNullFields": "false"}) for x in (F.struct(*shared), own))
    frame = F.array(F.lit(""), F.concat(F.substring(record, F.lit(1), F.length(record) - 1), F.lit(',"locations":')), F.lit("}"))
    lists = ("data_flow", "proof_gaps", "counterevidence")
    keys = frame_keys("rule_id", "suggested_severity", "title", "description", "verdict_candidate", "code_surface", "source", "sink",
                      *lists, "parser_used", "exact_invoked_api", lists=lists)
    comma = F.when(F.col("emit_seq") == F.col("first_seq"), F.lit("")).otherwise(F.lit(","))
    results = findings.join(met, "repo").select(
        "repo", F.lit(1).alias("part"), "emit_seq", comma.alias("first"), locations.alias("value"), frame.alias("frame"), *keys)
    nothing = F.lit(None).cast(findings.schema["emit_seq"].dataType).alias("emit_seq")
    opened = firsts.select("repo", F.lit(0).alias("part"), nothing, sarif_head(tool, version).alias("value"))
    closed = firsts.select("repo", F.lit(2).alias("part"), nothing, F.lit(SARIF_END).alias("value"))
    return results.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)


def sarif_log(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """(repo, part, emit_seq, value): text pieces that make one SARIF log per repository in order."""
    whole = F.when(F.col("frame").isNull(), F.col("value")).otherwise(woven("frame", "first", "value"))
    return sarif_parts(findings, tool, version).select("repo", "part", "emit_seq", whole.alias("value"))


def report_parts(findings: DataFrame) -> DataFrame:
    """(repo, section_no, confidence_score, file_path, start_line, emit_seq, frame, f1, f2, shown): the blocks of the report.

    Location and evidence shown are a finding's own texts; what stands around them follows from its rule. 128 bits stand for a frame.
    """
    section = F.when(_is_review(), F.lit(1)).when(F.col("verdict_candidate") != "suppressed", F.lit(0))
    tick = lambda column: F.concat(F.lit("`"), column, F.lit("`"))
    text = F.lit
    evidence = _or(F.replace(F.col("evidence"), text("```"), text("``\u200b`")), fv.NO_SNIPPET)
    before = [
        F.concat(text("### "), F.col("title")),
        F.concat(text("- **Severity:** "), F.col("suggested_severity"), text(" | **Type:** "),
                 F.col("verdict_candidate"), text(" | **Confidence:** "), F.col("confidence_score").cast("string")),
        text("- **Location:** `"),
    ]
    between = [
        F.concat(text("` | **Root cause:** "), tick(_or(F.col("root_cause_id"), "unassigned"))),
        F.concat(text("- **Rule:** "), tick(F.col("rule_id")), text(" | **Code surface:** "),
                 tick(F.col("code_surface")), text(" | **Flow:** "), tick(F.col("flow_status"))),
        F.concat(text("- **Why raised:** "), F.col("description")),
        F.concat(text("- **Source → sink:** "), tick(_or(F.col("source"), "unknown")), text(" → "),
                 tick(_or(F.col("sink"), "unknown"))),
        F.concat(text("- **Observed controls:** "), _joined("observed_controls", fv.NONE_OBSERVED)),
        F.concat(text("- **Proof gaps:** "), _joined("proof_gaps", fv.NONE_RECORDED)),
        F.concat(text("- **Counterevidence:** "), _joined("counterevidence", fv.NONE_RECORDED)),
        F.concat(text("- **Reviewer action:** "),
                 F.coalesce(F.get("recommended_verification_steps", F.lit(0)), text(fv.DEFAULT_ACTION))),
        text("- **Evidence:**"), text("```text\n"),
    ]
    frame = F.array(F.concat_ws("\n", *before), F.concat_ws("\n", *between), text("\n```\n"))
    return findings.withColumn("section_no", section).filter(F.col("section_no").isNotNull()).select(
        "repo", "section_no", "confidence_score", "file_path", "start_line", "emit_seq",
        frame.alias("frame"), *frame_keys(
            "title", "suggested_severity", "verdict_candidate", "confidence_score", "root_cause_id", "rule_id", "code_surface",
            "flow_status", "description", "source", "sink", "observed_controls", "proof_gaps", "counterevidence",
            F.get("recommended_verification_steps", F.lit(0))), evidence.alias("shown"))


def report_blocks(findings: DataFrame) -> DataFrame:
    """(section, section_no, confidence_score, file_path, start_line, emit_seq, block) of the report."""
    section = F.when(F.col("section_no") == 0, F.lit(fv.REPORT_SECTIONS[0])).otherwise(F.lit(fv.REPORT_SECTIONS[1]))
    return report_parts(findings).select(
        "repo", "section_no", section.alias("section"), "confidence_score", "file_path", "start_line", "emit_seq",
        woven("frame", location(), "shown").alias("block"))


def simple_report(findings: DataFrame) -> DataFrame:
    """The plain report: one block per finding in emission order."""
    steps = F.concat(F.lit("['"), F.array_join("recommended_verification_steps", "', '"), F.lit("']"))
    verification = F.when(F.size("recommended_verification_steps") == 0, F.lit("[]")).otherwise(steps)
    lines = [
        F.concat(F.lit("## "), F.col("title")),
        F.concat(F.lit("- Rule: `"), F.col("rule_id"), F.lit("`")),
        F.concat(F.lit("- Classification: `"), F.col("classification"), F.lit("`")),
        F.concat(F.lit("- Severity: `"), F.col("suggested_severity"), F.lit("`")),
        F.concat(F.lit("- Location: `"), F.col("file_path"), F.lit(":"), F.col("start_line"), F.lit("`")),
        F.concat(F.lit("- Verification: "), verification),
        F.lit(""),
    ]
    return findings.select("repo", "emit_seq", F.concat_ws("\n", *lines).alias("block"))


def summary_root_causes(root_causes: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows of the summary's root-cause list: a heading row, then one row per distinct location."""
    places = compare.summary_locations(root_causes, findings)
    heads = root_causes.filter(~F.col("root_cause_type").isin(*fv.REVIEW_VERDICTS)).select(
        "repo", "root_cause_id", F.lit("").alias("location"),
        F.concat(F.lit("- `"), F.col("root_cause_id"), F.lit("` — "), F.col("title"), F.lit(" ("),
                 F.col("root_cause_type"), F.lit("; "), F.col("instance_count"), F.lit(" related instances)"))
        .alias("value"))
    rows = places.select("repo", "root_cause_id", "location",
                         F.concat(F.lit("  - Review location: `"), F.col("location"), F.lit("`")).alias("value"))
    return heads.unionByName(rows)


def summary_review_points(findings: DataFrame) -> DataFrame:
    value = F.concat(F.lit("- `"), F.col("id"), F.lit("` — "), F.col("title"), F.lit(" — `"),
                     F.col("file_path"), F.lit(":"), F.col("start_line"), F.lit("`"))
    return review_points(findings).select("repo", "emit_seq", value.alias("value"))


def metadata(files: DataFrame, skipped: DataFrame, frameworks: DataFrame, target: str, options) -> DataFrame:
    """One row of run metadata. Languages and frameworks come from fixed lists, so their
    collections are bounded."""
    counted = files.groupBy("language").agg(F.count("*").alias("n"))
    by_language = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files_scanned"),
        F.array_sort(F.collect_list(F.struct("language", "n"))).alias("languages"))
    names = frameworks.agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))
    return by_language.crossJoin(skipped.agg(F.count("*").alias("files_skipped"))).crossJoin(names).select(
        F.lit(target).alias("target"), F.current_timestamp().alias("started_at"),
        "files_scanned", "files_skipped", "languages", "frameworks",
        F.lit(options.quotes.hide_secrets).alias("redaction"), F.lit(options.quotes.lines > 0).alias("snippets"))


# --- writing -----------------------------------------------------------------------------------


def write_scan(path: str, findings: DataFrame, routes: DataFrame | None = None, inventory: DataFrame | None = None,
               errors: DataFrame | None = None, roots_only: bool = False, files: DataFrame | None = None,
               frameworks: DataFrame | None = None, tool: str = "codetrawl", version: str = "1") -> None:
    """Write the tables and documents of a scan below ``path``.

    With ``files`` (repo, language, ...) every repository has a summary, and those without findings a report and a log too.

    Findings are written first and read back, so the scan itself runs once and everything after
    it starts from files that outlive any executor.
    """
    from . import documents  # which is made of the pieces above

    spark = findings.sparkSession
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    stored = spark.read.schema(findings.schema).parquet(f"{path}/findings")
    roots = correlate.root_causes(stored)
    roots.write.mode("overwrite").parquet(f"{path}/root_causes")
    stored_roots = spark.read.schema(roots.schema).parquet(f"{path}/root_causes")
    correlate.root_cause_instances(stored).write.mode("overwrite").parquet(f"{path}/root_cause_instances")
    if roots_only:
        return
    repos = None if files is None else files.select("repo").distinct()
    stored.transform(finding_records).orderBy("repo", "emit_seq").select("value").write.mode("overwrite").text(
        f"{path}/findings_json")
    stored_roots.orderBy("repo", "root_cause_id").write.mode("overwrite").json(f"{path}/root_causes_json")
    review_points(stored).write.mode("overwrite").parquet(f"{path}/review_points")
    documents.write_documents(documents.sarif_pieces(stored, tool, version, repos), f"{path}/sarif")
    documents.write_documents(documents.report_pieces(stored, stored_roots, repos), f"{path}/report")
    if files is not None:
        facts = frameworks if frameworks is not None else repos.select("repo", F.lit(None).cast("string").alias("framework"))
        documents.write_documents(documents.summary_pieces(stored, stored_roots, files, facts), f"{path}/summary")
    compare.handoff(stored_roots, stored).drop("emit_seq").write.mode("overwrite").json(f"{path}/context_request")
    if routes is not None:
        routes.write.mode("overwrite").parquet(f"{path}/routes")
    if inventory is not None:
        inventory.write.mode("overwrite").parquet(f"{path}/inventory")
    if errors is not None:
        errors.write.mode("overwrite").json(f"{path}/errors")
