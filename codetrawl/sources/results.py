"""Results of other scanners and of earlier runs.

Every reader takes raw documents as a table (file, content) so that large result stores can be
kept in any format; ``read_documents`` makes such a table from files. Documents are parsed with
fixed schemas; one that does not parse becomes an error row and the rest goes on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import ids
from ..functions import text as tx
from ..functions.sqltext import lit
from ..operators.rules import finding_columns
from ..schema import FINDINGS

SEMGREP = (
    "struct<results: array<struct<check_id: string, path: string, start: struct<line: string>, "
    "extra: struct<message: string, severity: string, metadata: struct<confidence: string, cwe: string>>>>>"
)
GITLEAKS = "array<struct<RuleID: string, Description: string, File: string, StartLine: string>>"
BANDIT = (
    "struct<results: array<struct<test_id: string, issue_text: string, filename: string, line_number: string, "
    "issue_severity: string, issue_confidence: string, issue_cwe: struct<id: string>>>>"
)
_GOSEC_ISSUE = (
    "array<struct<rule_id: string, rule: string, details: string, file: string, line: string, severity: string, "
    "confidence: string, cwe: string>>"
)
GOSEC = tuple(f"struct<{name}: {_GOSEC_ISSUE}>" for name in ("Issues", "issues"))
_SOURCE_LINE = "array<struct<_sourcepath: string, _start: string>>"
# in the order in which they stand in a report; the instance's own source line is the last
_PLACES = ("Class", "Type", "Method", "Field", "LocalVariable")
_CORRUPT = "_corrupt_record"
FINDSECBUGS = ", ".join((
    "_type string, _priority string", *(f"{name} struct<SourceLine: {_SOURCE_LINE}>" for name in _PLACES),
    f"SourceLine {_SOURCE_LINE}", f"{_CORRUPT} string"))


# --- normalisation ---------------------------------------------------------------------------


def normal_severity(value: Column) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.isin(*fv.SEVERITIES), lowered).otherwise(F.lit("medium"))


def confidence_score(value: Column) -> Column:
    lowered = F.lower(F.when(value == "", F.lit(None)).otherwise(value))
    cases = F.when(lowered.isNull(), F.lit(fv.CONFIDENCE_SCORES["medium"]))
    for name, number in fv.CONFIDENCE_SCORES.items():
        cases = cases.when(lowered == name, F.lit(number))
    return cases.otherwise(F.lit(fv.CONFIDENCE_OTHER))


def normal_cwes(value: Column) -> Column:
    """CWE ids of a scalar or of the text of a JSON array."""
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    values = F.coalesce(listed, F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value)))
    return F.transform(
        values, lambda v: F.when(F.upper(v).startswith("CWE-"), v).otherwise(F.concat(F.lit("CWE-"), v)))


def normal_line(value: Column) -> Column:
    number = F.trim(F.get(F.split(value, ":"), F.lit(0)))
    return F.greatest(F.lit(1), F.coalesce(number.try_cast("int"), F.lit(1)))


def normal_path(value: Column, root: str | None = None) -> Column:
    path = F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))
    if root:
        prefix = root.rstrip("/") + "/"
        path = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)
    return F.translate(path, "\\", "/")


def to_findings(results: DataFrame) -> DataFrame:
    """Findings of normalised results.

    ``results`` has repo, tool, rule, title, message, path, line, severity, confidence, cwes,
    seq_file, seq_pos, where path, line and cwes are normal already.
    """
    tool, rule, title, path, line = (F.col(c) for c in ("tool", "rule", "title", "path", "line"))
    prepared = results.withColumns({
        "score": confidence_score(F.col("confidence")),
        "hidden": tx.redact(F.col("message")),
        "level": normal_severity(F.col("severity")),
        "stable": ids.external_id(tool, rule, path, line, title),
    })
    return prepared.selectExpr(*finding_columns(dict(
        repo="repo", id="stable", rule_id="concat_ws('.', 'EXT', upper(tool), rule)",
        title="if(title = '', concat(tool, ' result ', rule), title)", description="hidden",
        category="'external_tool'", subcategory="'imported-result'", language="'unknown'",
        classification="if(score >= 80, 'high_confidence_candidate', 'review_lead')",
        confidence_score="score", suggested_severity="level", cwe_ids="cwes", file_path="path", start_line="line",
        end_line="line", evidence="hidden", analyzer="concat('external.', tool)", external_tool="tool",
        external_rule_id="rule",
        verdict_candidate="if(score >= 80, 'high_confidence_candidate', 'secure_coding_concern')",
        parser_used="'external-result'", sink=lit(fv.IMPORT_SINK).text, sink_detected="true",
        flow_status="'sink_only'", proof_gaps=f"array({lit(fv.IMPORT_GAP).text})",
        recommended_verification_steps=f"array({lit(fv.IMPORT_VERIFY).text})",
        emit_seq="named_struct('origin', 1, 'file', seq_file, 'phase', 0, 'pos', cast(seq_pos as bigint), 'ord', 0)",
    )))


# --- readers ------------------------------------------------------------------------------------


def read_documents(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """(repo, file, content) of the files below a path, one row per file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.lit(repo).alias("repo"), F.col("_metadata.file_path").alias("file"),
                       F.col("value").alias("content"))


def _parsed(documents: DataFrame, schema: str) -> Column:
    """The document with the fixed schema; null when it does not parse as JSON."""
    return F.when(F.try_parse_json("content").isNotNull(), F.from_json("content", schema))


def _is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def _items(documents: DataFrame, array: Column) -> DataFrame:
    return documents.select("repo", F.col("file").alias("seq_file"), F.posexplode(array).alias("seq_pos", "item"))


def _item(name: str, default: str | None = None) -> Column:
    value = F.col(f"item.{name}")
    return value if default is None else F.coalesce(value, F.lit(default))


def semgrep(documents: DataFrame, root: str | None = None) -> DataFrame:
    rows = _items(documents, _parsed(documents, SEMGREP)["results"])
    return _normal(rows, "semgrep", root, rule=_item("check_id", "unknown"),
                   title=F.coalesce(_item("extra.message"), _item("check_id", fv.IMPORT_TITLES["semgrep"])),
                   message=_item("extra.message", fv.IMPORT_MESSAGES["semgrep"]), path=_item("path"),
                   line=_item("start.line"), severity=_item("extra.severity"),
                   confidence=_item("extra.metadata.confidence"), cwe=_item("extra.metadata.cwe"))


def gitleaks(documents: DataFrame, root: str | None = None) -> DataFrame:
    # the parser would take an object for a list of one
    rows = _items(documents.filter(_is_list(F.try_parse_json("content"))), _parsed(documents, GITLEAKS))
    return _normal(rows, "gitleaks", root, rule=_item("RuleID", "unknown"),
                   title=_item("Description", fv.IMPORT_TITLES["gitleaks"]),
                   message=_item("Description", fv.IMPORT_MESSAGES["gitleaks"]), path=_item("File"),
                   line=_item("StartLine"), severity=F.lit("high"), confidence=F.lit("high"),
                   cwe=F.lit(None).cast("string"))


def bandit(documents: DataFrame, root: str | None = None) -> DataFrame:
    rows = _items(documents, _parsed(documents, BANDIT)["results"])
    return _normal(rows, "bandit", root, rule=_item("test_id", "unknown"),
                   title=_item("issue_text", fv.IMPORT_TITLES["bandit"]),
                   message=_item("issue_text", fv.IMPORT_MESSAGES["bandit"]), path=_item("filename"),
                   line=_item("line_number"), severity=_item("issue_severity"),
                   confidence=_item("issue_confidence"), cwe=_item("issue_cwe.id"))


def gosec(documents: DataFrame, root: str | None = None) -> DataFrame:
    # two schemas because field names that differ in case only can not be told apart in one
    upper, lower = (_parsed(documents, schema) for schema in GOSEC)
    rows = _items(documents, F.coalesce(upper["Issues"], lower["issues"]))
    return _normal(rows, "gosec", root, rule=F.coalesce(_item("rule_id"), _item("rule", "unknown")),
                   title=_item("details", fv.IMPORT_TITLES["gosec"]),
                   message=_item("details", fv.IMPORT_MESSAGES["gosec"]), path=_item("file"),
                   line=_item("line"), severity=_item("severity"), confidence=_item("confidence"),
                   cwe=_item("cwe"))


def findsecbugs(bugs: DataFrame, root: str | None = None) -> DataFrame:
    """Findings of BugInstance rows as read by ``read_findsecbugs`` (repo, seq_file, item)."""
    # a record has no position of its own; its content gives one that does not depend on how files are split
    rows = bugs.withColumn("seq_pos", F.xxhash64("item"))
    place = F.get(F.coalesce(*[_item(f"{name}.SourceLine") for name in _PLACES], _item("SourceLine")), F.lit(0))
    return _normal(rows, "findsecbugs", root, rule=_item("_type", "unknown"),
                   title=_item("_type", fv.IMPORT_TITLES["findsecbugs"]),
                   message=_item("_type", fv.IMPORT_MESSAGES["findsecbugs"]), path=place["_sourcepath"],
                   line=place["_start"], severity=_item("_priority"), confidence=F.lit("medium"),
                   cwe=F.lit(None).cast("string"))


def read_findsecbugs(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """(repo, seq_file, item): one row per whole BugInstance of the XML files below a path.

    Broken files are rows of ``xml_errors``; nothing is made up from their fragments.
    """
    read = spark.read.format("xml").option("rowTag", "BugInstance").option("columnNameOfCorruptRecord", _CORRUPT)
    rows = read.schema(FINDSECBUGS).load(path).filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    return rows.select(F.lit(repo).alias("repo"), F.col("_metadata.file_path").alias("seq_file"),
                       F.struct(*[F.col(c) for c in rows.columns]).alias("item"))


def _normal(rows: DataFrame, tool: str, root: str | None, *, rule, title, message, path, line, severity,
            confidence, cwe) -> DataFrame:
    return to_findings(rows.select(
        "repo", F.lit(tool).alias("tool"), rule.alias("rule"), title.alias("title"), message.alias("message"),
        normal_path(path, root).alias("path"), normal_line(line).alias("line"), severity.alias("severity"),
        confidence.alias("confidence"), normal_cwes(cwe).alias("cwes"), "seq_file", "seq_pos",
    ))


JSON_READERS = {"semgrep": semgrep, "gitleaks": gitleaks, "bandit": bandit, "gosec": gosec}


# where the list of results is in a document; the whole document for null
_RESULT_KEYS = {"semgrep": ("results",), "bandit": ("results",), "gosec": ("Issues", "issues"), "gitleaks": None}


def import_errors(documents: DataFrame, tool: str) -> DataFrame:
    """(repo, path, tool, error): documents of a tool that do not parse or do not hold a list of results."""
    value, keys = F.try_parse_json("content"), _RESULT_KEYS[tool]

    if keys is None:
        fits = _is_list(value)
    else:
        parts = [F.try_variant_get(value, f"$.{key}", "variant") for key in keys]
        fits = F.schema_of_variant(value).startswith("OBJECT") & _is_list(F.coalesce(*parts, F.parse_json(F.lit("[]"))))
    error = F.when(value.isNull(), F.lit("not valid JSON")).when(~fits, F.lit("not a list of results"))
    return documents.withColumn("_why", error).filter(F.col("_why").isNotNull()).select(
        "repo", F.col("file").alias("path"), F.lit(tool).alias("tool"),
        F.concat(F.lit(f"{tool} import failed: "), "_why").alias("error"))


def xml_errors(documents: DataFrame, tool: str = "findsecbugs") -> DataFrame:
    """(repo, path, tool, error): documents that are not well-formed XML."""
    parsed = F.from_xml("content", F.lit(f"{_CORRUPT} string"), {"columnNameOfCorruptRecord": _CORRUPT})
    broken = documents.filter(parsed.isNull() | parsed[_CORRUPT].isNotNull())
    return broken.select("repo", F.col("file").alias("path"), F.lit(tool).alias("tool"),
                         F.lit(f"{tool} import failed: not valid XML").alias("error"))


def import_results(spark: SparkSession, specs: list[str], repo: str = "",
                   root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and errors of ``tool=path`` specifications; a bad one, and one that names no file, is an error row."""
    findings = spark.createDataFrame([], FINDINGS)
    problems = []
    errors = None
    for spec in specs:
        tool, separator, path = spec.partition("=")
        tool = tool.lower()
        if not separator:
            problems.append((repo, spec, "", f"invalid imported result specification: {spec}; use tool=path"))
        elif tool not in fv.IMPORT_TOOLS:
            problems.append((repo, path, tool, f"unsupported adapter: {tool}"))
        elif tool == "findsecbugs" or tool in JSON_READERS:
            try:
                documents = read_documents(spark, path, repo)
            except AnalysisException as problem:
                problems.append((repo, path, tool, f"{tool} import failed: {problem.getCondition()}"))
                continue
            if tool == "findsecbugs":
                found, broken = findsecbugs(read_findsecbugs(spark, path, repo), root), xml_errors(documents)
            else:
                found, broken = JSON_READERS[tool](documents, root), import_errors(documents, tool)
            findings = findings.unionByName(found)
            errors = broken if errors is None else errors.unionByName(broken)
    given = spark.createDataFrame(problems, "repo string, path string, tool string, error string")
    return findings, given if errors is None else given.unionByName(errors)


def read_findings(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """Findings written by an earlier run."""
    return spark.read.schema(FINDINGS).format(source_format).load(path)
