"""One query per operator, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrawl import Kept, ScanOptions, Sources, scan_files
from codetrawl import fixed_values as fv
from codetrawl.functions import paths
from codetrawl.functions import text as tx
from codetrawl.operators import authz, compare, correlate, enrich, graph, inventory, rules
from codetrawl.operators.lines import raw_lines, source_lines
from codetrawl.plans import documents as docs
from codetrawl.plans import reports
from codetrawl.plans.scan import local_findings
from codetrawl.schema import FINDINGS
from codetrawl.sources import files as fs
from codetrawl.sources import results, runs

from . import corpus, oracle
from .oracle import any_of, findings_ctes, findings_sql, in_list, lines_cte, q, redact_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def scratch(spark: SparkSession) -> str:
    """A new folder that every executor sees: below the shared one the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="codetrawl-")
    return f"{base.rstrip('/')}/codetrawl-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf)


def flag(column: str):
    return F.col(column).cast("int").cast("bigint").alias(column)


def joined(column: str, name: str | None = None, by: str = ","):
    return F.array_join(column, by).alias(name or column)


def view(findings: DataFrame) -> DataFrame:
    return findings.select(
        "repo", "file_path", F.col("start_line").cast("bigint").alias("start_line"), "id", "rule_id", "rule_family",
        "title", "category", "classification", "verdict_candidate", "suggested_severity",
        F.col("confidence_score").cast("bigint").alias("confidence_score"), joined("cwe_ids", "cwes"), "source",
        "sink", "exact_invoked_api", "flow_status", F.col("evidence_level").cast("bigint").alias("evidence_level"),
        "code_surface", flag("test_only"), "evidence",
    )


# --- sources ---------------------------------------------------------------------------------

AUX_NAMES = (*fv.MANIFEST_NAMES, "Jenkinsfile", "notes.txt", "deploy.SH")
IGNORE_TEXT = "lib\n/config/\n# demo\n  server/controllers  \n\n"
IGNORED = ("lib", "config", "server/controllers")
SMALL = 4_000


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A raw file listing made from documents: code files, other files, one ignore file per repository."""
    docs = documents(spark, sf)
    kind, place = F.col("doc_id") % 5, F.floor(F.col("doc_id") / 5) % 10
    directory = F.concat(corpus._pick(place, corpus.DIRECTORIES), F.lit("/"), F.col("source"), F.lit("/"))
    code = F.concat(directory, F.lit("f"), F.col("doc_id"), corpus._pick(kind, corpus.EXTENSIONS))
    other = F.concat(directory, F.lit("d"), F.col("doc_id"), F.lit("/"), corpus._pick(F.col("doc_id") % 16, AUX_NAMES))
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("\0"), F.col("text"))).otherwise(F.col("text"))
    rows = docs.select(
        F.col("lang").alias("repo"), F.explode(F.array(code, other)).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.col("doc_id") % 17 == 0).alias("is_symlink"),
        F.when(F.col("doc_id") % 19 == 0, F.lit("unreadable: denied")).alias("error"),
        content.cast("binary").alias("content"),
    )
    ignores = docs.groupBy(F.col("lang").alias("repo")).agg(F.count("*").alias("n")).select(
        "repo", F.lit(".gitignore").alias("path"), F.lit(len(IGNORE_TEXT)).cast("bigint").alias("size"),
        F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("error"),
        F.lit(IGNORE_TEXT).cast("binary").alias("content"))
    return rows.unionByName(ignores)


def _listing_sql() -> str:
    pick = corpus._sql_pick
    directory = f"{pick('(doc_id // 5 % 10)', corpus.DIRECTORIES)} || '/' || source || '/'"
    common = ("strlen(text)::BIGINT AS size, doc_id % 17 = 0 AS is_symlink, doc_id % 19 = 0 AS broken, "
              "doc_id % 13 = 0 AS has_nul")
    return f"""
    listing AS (
        SELECT lang AS repo, {directory} || 'f' || doc_id || {pick('(doc_id % 5)', corpus.EXTENSIONS)} AS path, {common}
        FROM documents
        UNION ALL
        SELECT lang, {directory} || 'd' || doc_id || '/' || {pick('(doc_id % 16)', AUX_NAMES)}, {common} FROM documents
        UNION ALL
        SELECT DISTINCT lang, '.gitignore', {len(IGNORE_TEXT)}, false, false, false FROM documents),
    named AS (SELECT *, string_split(path, '/') AS parts, regexp_extract(path, '([^/]*)$', 1) AS base,
                     lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM listing),
    typed AS (SELECT *, {_language_sql('ext')} AS language,
                     list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')) AS dirs FROM named)"""


def _language_sql(extension: str) -> str:
    whens = " ".join(f"WHEN {q(e)} THEN {q(l)}" for e, l in fv.LANGUAGE_BY_EXTENSION.items())
    return f"CASE {extension} {whens} END"


def _names_sql(names) -> str:
    return "[" + ", ".join(q(n) for n in names) + "]"


def _reason_sql(excludes=(), ignored=None, size: int = 2**62) -> str:
    named = f"list_has_any(string_split(d, '/'), {_names_sql(fs.excluded_names(excludes))})"
    test = f"list_has_any(string_split(lower(d), '/'), {_names_sql(fv.TEST_PARTS)})"
    if ignored:
        items = _names_sql(ignored)
        named = (f"({named} OR (NOT {test} AND (list_contains({items}, d) "
                 f"OR list_has_any(string_split(d, '/'), {items}))))")
    return f"""
    marked AS (SELECT *, list_filter(dirs, lambda d: {named})[1] AS excluded FROM typed),
    judged AS (SELECT *, CASE WHEN excluded IS NOT NULL THEN {q(fv.SKIP_EXCLUDED)}
                              WHEN is_symlink THEN {q(fv.SKIP_SYMLINK)}
                              WHEN broken THEN 'unreadable: denied'
                              WHEN language IS NULL THEN NULL
                              WHEN size > {size} THEN {q(fv.SKIP_SIZE)}
                              WHEN has_nul THEN {q(fv.SKIP_BINARY)} END AS reason FROM marked)"""


_SKIPPED_SQL = """SELECT repo, path, reason FROM judged WHERE excluded IS NULL AND reason IS NOT NULL
    UNION ALL SELECT DISTINCT repo, excluded, reason FROM judged WHERE excluded IS NOT NULL"""
_SCANNED_SQL = "SELECT repo, path, language, size FROM judged WHERE reason IS NULL AND language IS NOT NULL"


def _write_files(batches):
    for batch in batches:
        for root, path, text in batch.itertuples(index=False):
            target = os.path.join(root, path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8", newline="") as handle:
                handle.write(text)
        yield batch[["root"]].drop_duplicates()


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the corpus as a tree of files, then reads the tree."""
    base = scratch(spark).removeprefix("file://")
    files = corpus.files(spark, sf).select(F.concat(F.lit(base + "/"), F.col("repo")).alias("root"), "path", "text")
    # one row per repository tells which trees were written
    written = files.mapInPandas(_write_files, "root string").distinct().collect()
    roots = {os.path.basename(r.root): r.root for r in sorted(written)}
    scanned = fs.source_files(fs.classify(fs.read_tree(spark, roots)))
    return scanned.select("repo", "path", "language", "size", F.length("text").cast("bigint").alias("chars"),
                          "code_surface")


add("src_walk", _walk, f"""
    WITH f AS ({corpus.files_sql()})
    SELECT repo, path, language, strlen(text)::BIGINT AS size, length(text)::BIGINT AS chars, code_surface
    FROM f WHERE NOT starts_with(path, 'generated/')""")
add("src_language", lambda s, sf: listing(s, sf).select(
    "repo", "path", paths.language_of(F.col("path")).alias("language")).filter(F.col("language").isNotNull()),
    f"WITH {_listing_sql()} SELECT repo, path, language FROM typed WHERE language IS NOT NULL")
add("src_skip", lambda s, sf: fs.skipped_files(fs.classify(listing(s, sf), ScanOptions(Sources(largest=SMALL)))),
    f"WITH {_listing_sql()}, {_reason_sql(size=SMALL)} {_SKIPPED_SQL}")
add("src_exclude_dirs", lambda s, sf: fs.source_files(
    fs.classify(listing(s, sf), ScanOptions(Sources(pruned=("demo", "src3"))))).select("repo", "path", "language", "size"),
    f"WITH {_listing_sql()}, {_reason_sql(('demo', 'src3'))} {_SCANNED_SQL}")


def _gitignored(spark: SparkSession, sf: str) -> DataFrame:
    raw = listing(spark, sf)
    options = ScanOptions(Sources(ignore_file=True))
    return fs.source_files(fs.classify(raw, options, fs.ignore_items(raw))).select("repo", "path", "language", "size")


add("src_gitignore", _gitignored, f"WITH {_listing_sql()}, {_reason_sql((), IGNORED)} {_SCANNED_SQL}")
add("src_include_glob", lambda s, sf: corpus.files(s, sf).filter(
    paths.matches_any_glob(F.col("path"), ("src1*/*.py", "*9.go", "java/src[2-4]/f?[!0].*"))).select("repo", "path"),
    f"""WITH f AS ({corpus.files_sql()}) SELECT repo, path FROM f
        WHERE regexp_matches(path, '(^|/)src1[^/]*/[^/]*\\.py$') OR regexp_matches(path, '(^|/)[^/]*9\\.go$')
           OR regexp_matches(path, '(^|/)java/src[2-4]/f[^/][^0]\\.[^/]*$')""")
add("src_surface", lambda s, sf: corpus.files(s, sf).select(
    "repo", "path", paths.surface_of(F.col("path")).alias("code_surface")),
    f"WITH f AS ({corpus.files_sql()}) SELECT repo, path, code_surface FROM f")
add("src_manifests", lambda s, sf: inventory.manifests(listing(s, sf)),
    f"WITH {_listing_sql()} SELECT repo, path FROM named WHERE NOT is_symlink AND {in_list('base', fv.MANIFEST_NAMES)}")
_LOCK = "(contains(path, 'lock') OR ends_with(path, 'go.sum') OR ends_with(path, 'requirements.txt'))"
_BUILD = "(" + " OR ".join(f"ends_with(path, {q(x)})" for x in fv.BUILD_SUFFIXES) + ")"


def _lock_build(spark: SparkSession, sf: str) -> DataFrame:
    known = inventory.manifests(listing(spark, sf))
    return inventory.lock_files(known).withColumn("kind", F.lit("lock")).unionByName(
        inventory.build_files(known).withColumn("kind", F.lit("build")))


_MANIFESTS_SQL = f"mf AS (SELECT * FROM named WHERE NOT is_symlink AND {in_list('base', fv.MANIFEST_NAMES)})"
add("src_lock_build", _lock_build, f"""WITH {_listing_sql()}, {_MANIFESTS_SQL}
    SELECT repo, path, 'lock' AS kind FROM mf WHERE {_LOCK} UNION ALL
    SELECT repo, path, 'build' FROM mf WHERE {_BUILD}""")
_DEPLOY = any_of("lower(base)", fv.DEPLOYMENT_NAME_PARTS)
add("src_deploy_files", lambda s, sf: inventory.deployment_files(listing(s, sf)),
    f"WITH {_listing_sql()} SELECT repo, path FROM named WHERE NOT is_symlink AND {_DEPLOY}")

# --- imported results ----------------------------------------------------------------------------
# Tool documents are made from events, fifty results each, and parsed back by the importers.


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
    severity = corpus._pick(F.col("event_id") % 5, ("ERROR", "High", "low", "critical", "INFO"))
    confidence = corpus._pick(F.col("event_id") % 4, ("HIGH", "medium", "low", "certain"))
    cwe = corpus._pick(F.col("event_id") % 3, ("CWE-79", "89", "cwe-22"))
    place = F.concat(F.lit("/work/app/src\\u"), F.col("user_id"), F.lit(".py"))
    text = F.concat(F.lit("event "), F.col("event_type"), F.lit(" token="), F.lit("abcdefgh"), F.col("event_id"))
    return e.select("event_id", F.concat(F.lit("doc-"), F.floor(F.col("event_id") / 50)).alias("file"),
                    F.concat(F.lit("rule."), F.col("event_type")).alias("rule"), text.alias("message"),
                    place.alias("path"), (F.col("event_id") % 90 - 5).alias("line"), severity.alias("severity"),
                    confidence.alias("confidence"), cwe.alias("cwe"))


def _events_sql() -> str:
    pick = corpus._sql_pick
    return f"""ev AS (SELECT event_id, 'doc-' || (event_id // 50) AS file, 'rule.' || event_type AS rule,
        'event ' || event_type || ' token=abcdefgh' || event_id AS message,
        'src/u' || user_id || '.py' AS path, greatest(1, event_id % 90 - 5) AS line,
        {pick('(event_id % 5)', ('ERROR', 'High', 'low', 'critical', 'INFO'))} AS severity,
        {pick('(event_id % 4)', ('HIGH', 'medium', 'low', 'certain'))} AS confidence,
        {pick('(event_id % 3)', ('CWE-79', '89', 'cwe-22'))} AS cwe FROM events)"""


def _tool_documents(spark: SparkSession, sf: str, item, wrap) -> DataFrame:
    rows = _events(spark, sf).select("file", "event_id", item.alias("item"))
    grouped = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("event_id", "item"))).alias("rows"))
    items = F.transform("rows", lambda r: r["item"])
    return grouped.select(F.lit("app").alias("repo"), "file", F.to_json(wrap(items)).alias("content"))


def _semgrep_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    item = F.struct(c("rule").alias("check_id"), "path", F.struct(c("line").alias("line")).alias("start"),
                    F.struct("message", "severity", F.struct(
                        "confidence", F.array("cwe").alias("cwe")).alias("metadata")).alias("extra"))
    return _tool_documents(spark, sf, item, lambda items: F.struct(items.alias("results")))


def _gitleaks_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    item = F.struct(c("rule").alias("RuleID"), c("message").alias("Description"), c("path").alias("File"),
                    c("line").alias("StartLine"))
    return _tool_documents(spark, sf, item, lambda items: items)


def _bandit_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    number = F.regexp_extract("cwe", r"(\d+)", 1).cast("int")
    item = F.struct(c("rule").alias("test_id"), c("message").alias("issue_text"), c("path").alias("filename"),
                    c("line").alias("line_number"), c("severity").alias("issue_severity"),
                    c("confidence").alias("issue_confidence"), F.struct(number.alias("id")).alias("issue_cwe"))
    return _tool_documents(spark, sf, item, lambda items: F.struct(items.alias("results")))


def _gosec_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    place = F.concat(c("line").cast("string"), F.lit(":3"))
    item = F.struct(c("rule").alias("rule_id"), c("message").alias("details"), c("path").alias("file"),
                    place.alias("line"), "severity", "confidence", "cwe")
    return _tool_documents(spark, sf, item, lambda items: F.struct(items.alias("Issues")))


def _findsecbugs(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark)
    place = F.array(F.struct(F.col("path").alias("_sourcepath"), F.col("line").alias("_start")),
                    F.struct(F.lit("other").alias("_sourcepath"), F.lit(1).cast("bigint").alias("_start")))
    rows = _events(spark, sf).select(F.col("rule").alias("_type"), F.col("severity").alias("_priority"),
                                     F.struct(place.alias("SourceLine")).alias("Class"))
    rows.write.format("xml").option("rootTag", "BugCollection").option("rowTag", "BugInstance").save(f"{folder}/bugs")
    return results.findsecbugs(results.read_findsecbugs(spark, f"{folder}/bugs", "app"), root="/work/app")


def imported_view(findings: DataFrame) -> DataFrame:
    return findings.select(
        "repo", "id", "rule_id", "title", "description", "classification", "verdict_candidate", "suggested_severity",
        F.col("confidence_score").cast("bigint").alias("confidence_score"), joined("cwe_ids", "cwes"), "file_path",
        F.col("start_line").cast("bigint").alias("start_line"), "evidence", "analyzer", "external_rule_id",
        "flow_status", "sink", joined("proof_gaps"))


def _imported_sql(tool: str, severity: str, confidence: str, cwes: str, message: str = "message") -> str:
    score = f"CASE lower({confidence}) WHEN 'high' THEN 90 WHEN 'medium' THEN 65 WHEN 'low' THEN 35 ELSE 55 END"
    hidden = redact_sql("message")
    return f"""ext AS (
        SELECT 'app' AS repo, {q(tool)} AS tool, rule, {message} AS message, path, line, event_id, file,
               CASE WHEN lower({severity}) IN ('informational', 'low', 'medium', 'high', 'critical')
                    THEN lower({severity}) ELSE 'medium' END AS severity, {score} AS score, {cwes} AS cwes FROM ev),
    imported AS (
        SELECT repo, substr(sha256(tool || ':' || rule || ':' || path || ':' || line || ':' || message), 1, 16) AS id,
               'EXT.' || upper(tool) || '.' || rule AS rule_id, message AS title, {hidden} AS description,
               CASE WHEN score >= 80 THEN 'high_confidence_candidate' ELSE 'review_lead' END AS classification,
               CASE WHEN score >= 80 THEN 'high_confidence_candidate' ELSE 'secure_coding_concern' END
                   AS verdict_candidate,
               severity AS suggested_severity, score::BIGINT AS confidence_score, cwes, path AS file_path,
               line::BIGINT AS start_line, {hidden} AS evidence, 'external.' || tool AS analyzer,
               rule AS external_rule_id, 'sink_only' AS flow_status, {q(fv.IMPORT_SINK)} AS sink,
               {q(fv.IMPORT_GAP)} AS proof_gaps, file, event_id
        FROM ext)"""


_CWE_SQL = "CASE WHEN upper(cwe) LIKE 'CWE-%' THEN cwe ELSE 'CWE-' || cwe END"
_CWE_NUMBER_SQL = "'CWE-' || regexp_extract(cwe, '(\\d+)', 1)"
_TOOLS = {
    "semgrep": (_semgrep_documents, results.semgrep, "severity", "confidence", _CWE_SQL),
    "gitleaks": (_gitleaks_documents, results.gitleaks, "'high'", "'high'", "''"),
    "bandit": (_bandit_documents, results.bandit, "severity", "confidence", _CWE_NUMBER_SQL),
    "gosec": (_gosec_documents, results.gosec, "severity", "confidence", _CWE_SQL),
}
for _tool, (_make, _read, _sev, _conf, _cwe) in _TOOLS.items():
    add(f"imp_{_tool}",
        lambda s, sf, make=_make, read=_read: imported_view(read(make(s, sf), "/work/app")),
        f"WITH {_events_sql()}, {_imported_sql(_tool, _sev, _conf, _cwe)} SELECT * EXCLUDE (file, event_id) FROM imported")
add("imp_findsecbugs", lambda s, sf: imported_view(_findsecbugs(s, sf)),
    f"WITH {_events_sql()}, {_imported_sql('findsecbugs', 'severity', chr(39) + 'medium' + chr(39), chr(39) * 2, 'rule')} "
    f"SELECT * EXCLUDE (file, event_id) FROM imported")
add("imp_norm_severity", lambda s, sf: _events(s, sf).select(
    "event_id", results.normal_severity(F.col("severity")).alias("severity")),
    f"""WITH {_events_sql()} SELECT event_id, CASE WHEN lower(severity) IN ('informational', 'low', 'medium', 'high',
        'critical') THEN lower(severity) ELSE 'medium' END AS severity FROM ev""")
add("imp_norm_confidence", lambda s, sf: _events(s, sf).select(
    "event_id", results.confidence_score(F.when(F.col("event_id") % 6 != 0, F.col("confidence"))).cast("bigint")
    .alias("score")),
    f"""WITH {_events_sql()} SELECT event_id, (CASE WHEN event_id % 6 = 0 THEN 65 WHEN lower(confidence) = 'high' THEN 90
        WHEN lower(confidence) = 'medium' THEN 65 WHEN lower(confidence) = 'low' THEN 35 ELSE 55 END)::BIGINT AS score
        FROM ev""")
add("imp_norm_cwe", lambda s, sf: _events(s, sf).select("event_id", F.array_join(results.normal_cwes(
    F.when(F.col("event_id") % 7 == 0, F.to_json(F.array("cwe", F.lit("1")))).when(
        F.col("event_id") % 7 != 1, F.col("cwe"))), ",").alias("cwes")),
    f"""WITH {_events_sql()} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN {_CWE_SQL} || ',CWE-1'
        WHEN event_id % 7 = 1 THEN '' ELSE {_CWE_SQL} END AS cwes FROM ev""")


def _line_text():
    n = (F.col("event_id") % 40 - 3).cast("string")
    return (F.when(F.col("event_id") % 5 == 0, F.concat(n, F.lit(":7"))).when(F.col("event_id") % 5 == 1, F.lit("x9"))
            .when(F.col("event_id") % 5 == 2, F.concat(n, F.lit("-14"))).when(F.col("event_id") % 5 == 3, n))


add("imp_norm_line", lambda s, sf: _events(s, sf).select(
    "event_id", results.normal_line(_line_text()).cast("bigint").alias("line")),
    """SELECT event_id, (CASE WHEN event_id % 5 IN (0, 3) THEN greatest(1, event_id % 40 - 3) ELSE 1 END)::BIGINT AS line
       FROM events""")
add("imp_norm_path", lambda s, sf: _events(s, sf).select("event_id", results.normal_path(
    F.when(F.col("event_id") % 3 == 0, F.col("path")).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("C:\\x\\"), F.col("rule"))), "/work/app/").alias("path")),
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'src/u' || user_id || '.py'
        WHEN event_id % 3 = 1 THEN 'C:/x/rule.' || event_type ELSE 'unknown' END AS path FROM events""")


def _to_finding(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    normal = e.select(
        F.lit("app").alias("repo"), F.lit("semgrep").alias("tool"), "rule", F.col("message").alias("title"), "message",
        results.normal_path(F.col("path"), "/work/app").alias("path"),
        results.normal_line(F.col("line").cast("string")).alias("line"), "severity", "confidence",
        results.normal_cwes(F.col("cwe")).alias("cwes"), F.col("file").alias("seq_file"),
        F.col("event_id").alias("seq_pos"))
    return imported_view(results.to_findings(normal))


add("imp_to_finding", _to_finding,
    f"WITH {_events_sql()}, {_imported_sql('semgrep', 'severity', 'confidence', _CWE_SQL)} "
    "SELECT * EXCLUDE (file, event_id) FROM imported")


_WRONG_SHAPE = {"gitleaks": '{"findings": []}', "semgrep": '{"results": 5}', "bandit": '{"results": {"a": 1}}', "gosec": '[{"Issues": []}]'}


def _import_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all five tools: every fourth does not parse, every fourth has another shape, every fourth is empty."""
    number = F.regexp_extract("file", r"(\d+)", 1).cast("int") % 4
    out = None
    for tool, (make, read, *_) in _TOOLS.items():
        broken = make(spark, sf).withColumn("content", F.when(number == 0, F.concat(F.lit("{"), F.col("content")))
                                            .when(number == 1, F.lit(_WRONG_SHAPE[tool])).when(number == 2, F.lit("")).otherwise(F.col("content")))
        errors = results.import_errors(broken, tool).select("repo", "path", "tool", "error", F.lit(0).cast("bigint").alias("results"))
        kept = read(broken).groupBy("repo", F.col("emit_seq.file").alias("path")).agg(F.count("*").alias("n"))
        rows = errors.unionByName(kept.select("repo", "path", F.lit(tool).alias("tool"), F.lit("").alias("error"), F.col("n").alias("results")))
        out = rows if out is None else out.unionByName(rows)
    # of XML another shape is no fault: it holds no bugs
    bug = F.concat(F.lit('<BugCollection><BugInstance type="'), F.col("file"), F.lit('"/></BugCollection>'))
    reports_ = _semgrep_documents(spark, sf).withColumn("content", F.when(number == 0, F.replace(bug, F.lit("</BugCollection>"), F.lit("")))
                                                        .when(number == 1, F.lit("<Report><Item/></Report>")).when(number == 2, F.lit("")).otherwise(bug))
    return out.unionByName(results.xml_errors(reports_).select("repo", "path", "tool", "error", F.lit(0).cast("bigint").alias("results")))


add("imp_errors", _import_errors, """
    WITH d AS (SELECT event_id // 50 AS d, count(*) AS n FROM events GROUP BY 1)
    SELECT 'app' AS repo, 'doc-' || d AS path, tool,
           CASE WHEN d % 4 IN (0, 2) THEN tool || ' import failed: not valid JSON'
                WHEN d % 4 = 1 THEN tool || ' import failed: not a list of results' ELSE '' END AS error,
           CASE WHEN d % 4 < 3 THEN 0 ELSE n END::BIGINT AS results
    FROM d, (VALUES ('semgrep'), ('gitleaks'), ('bandit'), ('gosec')) tools(tool)
    UNION ALL SELECT 'app', 'doc-' || d, 'findsecbugs', 'findsecbugs import failed: not valid XML', 0 FROM d WHERE d % 4 IN (0, 2)""")


def _reread(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written by one run and read back by the next."""
    folder = scratch(spark)
    local_findings(corpus.files(spark, sf)).write.mode("overwrite").parquet(f"{folder}/findings")
    return view(results.read_findings(spark, f"{folder}/findings"))


add("src_results", _reread, findings_sql())

# --- lines ------------------------------------------------------------------------------------

add("ln_split", lambda s, sf: raw_lines(documents(s, sf).select("doc_id", "text")).select(
    "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "raw"),
    f"""WITH a AS (SELECT doc_id, {oracle.lines_of('text')} AS l FROM documents)
        SELECT doc_id, unnest(range(1, len(l) + 1))::BIGINT AS line_no, unnest(l) AS raw FROM a""")


def _masked(column: str, languages) -> Query:
    return lambda s, sf: source_lines(corpus.files(s, sf).filter(F.col("language").isin(*languages))).select(
        "repo", "path", F.col("line_no").cast("bigint").alias("line_no"), F.col(column).alias("line"))


def _masked_sql(column: str, languages) -> str:
    return (f"WITH {lines_cte()} SELECT repo, path, n::BIGINT AS line_no, {column} AS line FROM lines "
            f"WHERE {in_list('language', languages)}")


for _name, _column, _sql_column, _languages in (
    ("ln_strip_java", "uncommented", "unc", ("java",)),
    ("ln_strip_js", "uncommented", "unc", ("javascript", "typescript")),
    ("ln_mask_java", "code", "code", ("java",)),
    ("ln_mask_js", "code", "code", ("javascript", "typescript")),
    ("ln_mask_go", "code", "code", ("go",)),
    ("ln_mask_python", "code", "code", ("python",)),
):
    add(_name, _masked(_column, _languages), _masked_sql(_sql_column, _languages))


def _windows(column: str, expression) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        text = tx.normal_breaks(F.col("text"))
        arrays = documents(spark, sf).select("doc_id", tx.split_lines(text).alias("lines"))
        rows = arrays.select("doc_id", "lines", F.posexplode(tx.computed("lines")).alias("pos", "raw"))
        number = F.col("pos") + 1
        return rows.select("doc_id", number.cast("bigint").alias("line_no"),
                           expression(F.col("lines"), number).alias(column))
    return query


def _windows_sql(column: str, before: int, after: int, wrap=lambda e: e) -> str:
    frame = oracle._frame("raw", before, after).replace("OVER w", "OVER w")
    return f"""WITH a AS (SELECT doc_id, {oracle.lines_of('text')} AS l FROM documents),
        b AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS raw FROM a),
        c AS (SELECT doc_id, n, {frame} AS v FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n))
        SELECT doc_id, n::BIGINT AS line_no, {wrap('v')} AS {column} FROM c"""


add("ln_context", _windows("context", tx.context), _windows_sql("context", 1, 2))
add("ln_upload_context", _windows("context", tx.upload_context), _windows_sql("context", 19, 3))
add("ln_snippet", _windows("evidence", tx.snippet),
    _windows_sql("evidence", 0, 2, lambda v: redact_sql(v, True)))
add("ln_redact", lambda s, sf: documents(s, sf).select("doc_id", tx.redact(F.col("text")).alias("text")).unionByName(
    s.read.parquet(f"{sf}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 10**9).alias("doc_id"), tx.redact(F.col("text")).alias("text"))
).unionByName(corpus.files(s, sf).select(
    F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint").alias("doc_id"), tx.redact(F.col("text")).alias("text"))),
    f"""WITH f AS ({corpus.files_sql()}) SELECT doc_id, {redact_sql('text')} AS text FROM documents UNION ALL
        SELECT conv_id * 1000 + turn + 1000000000, {redact_sql('text')} FROM conversations UNION ALL
        SELECT doc_id, {redact_sql('text')} FROM f""")
add("ln_trim_evidence", lambda s, sf: raw_lines(documents(s, sf).select("doc_id", "text")).select(
    "doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.trimmed_evidence(F.col("raw"), fv.EVIDENCE_CHARS).alias("evidence")),
    f"""WITH a AS (SELECT doc_id, {oracle.lines_of('text')} AS l FROM documents),
        b AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS raw FROM a)
        SELECT doc_id, n::BIGINT AS line_no, substring(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), 1, 300) AS evidence
        FROM b""")

# --- rules ----------------------------------------------------------------------------------------


def _rule(variants, select=view) -> Query:
    wanted = frozenset(variants)
    return lambda s, sf: select(local_findings(corpus.files(s, sf), only=wanted))


def _add_rule(name: str, variants) -> None:
    add(name, _rule(variants), findings_sql(frozenset(variants)))


for _entry in fv.GENERIC_RULES:
    _add_rule(_entry[0], (_entry[0], "r_random_plain") if _entry[0] == "r_random" else (_entry[0],))
_add_rule("r_py_authz", ("r_py_authz",))

# What only a parser sees, behind the Python files of the corpus: a file that does not parse, a string whose lines begin
# at column 0 inside a function and a decorator outside of it, a comment behind a function of one line.
_BROKEN = "def delete_broken(:\n"
_SPANNING = '@require_role("x")\ndef transfer_all(y):\n    text = """\nowner at column 0\n"""\n    send(text)\n'
_ONE_LINE = "def login_now(x): return x  # owner checked\n"


def _parsed_functions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.floor(F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long") / 5) % 4
    more = F.when(kind == 0, _BROKEN).when(kind == 1, _SPANNING).when(kind == 2, _ONE_LINE).otherwise("")
    files = corpus.files(spark, sf).withColumn("text", F.concat("text", more))
    return authz.functions_without_control(files).select("repo", "path", F.col("line_no").cast("bigint").alias("line_no"), "function")


add("r_py_authz_parsed", _parsed_functions, f"""WITH {findings_ctes(frozenset({'r_py_authz'}))}
    SELECT a.repo, a.path, a.n::BIGINT AS line_no, a.function FROM authz a JOIN files f ON f.repo = a.repo AND f.path = a.path
    WHERE f.doc_id // 5 % 4 <> 0
    UNION ALL
    SELECT l.repo, l.path, max(l.n)::BIGINT + 1, 'login_now' FROM lines l JOIN files f ON f.repo = l.repo AND f.path = l.path
    WHERE f.language = 'python' AND f.doc_id // 5 % 4 = 2 GROUP BY l.repo, l.path""")
for _name, _variants in {
    "j_secret_assign": ("j_secret_assign",),
    "j_secret_awsctor": ("j_secret_awsctor", "j_secret_awsctor_test"),
    "j_secret_literal": ("j_secret_literal", "j_secret_literal_test"),
    "j_log": ("j_log",),
    "j_exec_runtime": ("j_exec_runtime", "j_exec_runtime_controlled"),
    "j_exec_builder": ("j_exec_builder", "j_exec_builder_controlled"),
    "j_exec_engine": ("j_exec_engine",),
    "j_sql": ("j_sql",),
    "j_upload": ("j_upload", "j_upload_utility", "j_upload_validated"),
    "j_upload_name": ("j_upload_name",),
    "j_path": ("j_path",),
    "j_deser": ("j_deser",),
    "j_tls": ("j_tls",),
    "j_random": ("j_random",),
    "js_secret": ("js_secret", "js_secret_assign"),
    "js_log": ("js_log", "js_log_presence"),
    "js_exec": ("js_exec", "js_exec_controlled", "js_exec_eval", "js_exec_eval_controlled"),
    "js_formdata": ("js_formdata",),
    "js_upload": ("js_upload",),
    "js_upload_name": ("js_upload_name",),
    "js_sql": ("js_sql",),
    "js_ssrf": ("js_ssrf",),
    "js_render": ("js_render",),
}.items():
    _add_rule(_name, _variants)

_GENERIC = frozenset(k for k in (e["key"] for e in rules.catalogue_entries()) if k.startswith("r_"))
_JAVA = frozenset(k for k in (e["key"] for e in rules.catalogue_entries()) if k.startswith("j_"))
_SCRIPT = frozenset(k for k in (e["key"] for e in rules.catalogue_entries()) if k.startswith("js_"))


def emitted(findings: DataFrame) -> DataFrame:
    """The fields an emitter fills in."""
    return findings.select(
        "repo", "file_path", F.col("start_line").cast("bigint").alias("start_line"), "id", "rule_id", "description",
        "subcategory", "language", "analyzer", joined("data_flow"), joined("observed_controls"),
        joined("missing_or_questionable_controls"), joined("missing_controls"),
        joined("false_positive_conditions"), joined("recommended_verification_steps"), "recommended_remediation",
        joined("proof_gaps"), joined("counterevidence"), "parser_used", "syntax_node_type",
        flag("invocation_detected"), "reachability", "sensitive_value", "logging_sink", "verification_notes")


def _emitted_sql(family: str, variants) -> str:
    texts = {"java": fv.JAVA_TEXTS, "script": fv.JS_TEXTS}.get(family)
    if texts is None:
        parts = dict(sub="'secure-coding'", analyzer="language || '.lexical'",
                     flow="array_to_string(fixed_flow, ',')", missing="''", missing2="''",
                     remedy=q(fv.DEFAULT_REMEDIATION),
                     parser="CASE WHEN language = 'python' THEN 'python.ast' ELSE 'lexical' END",
                     node="CASE WHEN language = 'python' THEN 'Module' END", reach="'unknown'", notes="''")
    else:
        controls = ("CASE WHEN len(controls) = 0 THEN '[]' ELSE '[''' || array_to_string(controls, ''', ''') || "
                    "''']' END")
        parts = dict(sub=q(texts["subcategory"]), analyzer=q(texts["analyzer"]),
                     flow="'syntax=' || syntax || ',invoked_api=' || exact_invoked_api", missing=q(texts["missing"]),
                     missing2=q(texts["missing"]) if family == "java" else "''", remedy=q(texts["remediation"]),
                     parser=q(texts["parser"]), node="syntax",
                     reach="CASE WHEN test_only THEN 'test_only' ELSE 'unknown' END",
                     notes=f"'syntax=' || syntax || '; invoked_api=' || exact_invoked_api || '; source=' || "
                           f"coalesce(source, 'unknown') || '; sink=' || coalesce(sink, 'unknown') || '; controls=' || "
                           f"{controls} || '; reason=' || description")
    columns = f"""repo, file_path, start_line::BIGINT AS start_line, id, rule_id, description,
        {parts['sub']} AS subcategory, language, {parts['analyzer']} AS analyzer, {parts['flow']} AS data_flow,
        array_to_string(controls, ',') AS observed_controls, {parts['missing']} AS missing_or_questionable_controls,
        {parts['missing2']} AS missing_controls, array_to_string(false_positives, ',') AS false_positive_conditions,
        array_to_string(verify, ',') AS recommended_verification_steps, {parts['remedy']} AS recommended_remediation,
        array_to_string(proof_gaps, ',') AS proof_gaps, array_to_string(counterevidence, ',') AS counterevidence,
        {parts['parser']} AS parser_used, {parts['node']} AS syntax_node_type,
        invoked::INT::BIGINT AS invocation_detected, {parts['reach']} AS reachability, sensitive_value, logging_sink,
        {parts['notes']} AS verification_notes"""
    return findings_sql(variants, columns=columns)


add("r_emit", _rule(_GENERIC, emitted), _emitted_sql("generic", _GENERIC))
add("j_emit", _rule(_JAVA, emitted), _emitted_sql("java", _JAVA))
add("js_emit", _rule(_SCRIPT, emitted), _emitted_sql("script", _SCRIPT))


def _controls(group, pairs, context, array) -> Query:
    from codetrawl.functions.sqltext import Sql, present_names

    def query(spark: SparkSession, sf: str) -> DataFrame:
        lines = source_lines(corpus.files(spark, sf).filter(F.col("language").isin(*group)))
        grouped = lines.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct("line_no", array))).alias("l"))
        arrays = grouped.select("repo", "path", F.transform("l", lambda e: e[array]).alias("lines"))
        rows = arrays.select("repo", "path", "lines", F.posexplode(tx.computed("lines")).alias("pos", "_raw"))
        around = rows.select("repo", "path", (F.col("pos") + 1).cast("bigint").alias("line_no"),
                             tx.context(F.col("lines"), F.col("pos") + 1).alias(context))
        names = F.expr(present_names(Sql(context), pairs).text)
        return around.select("repo", "path", "line_no", F.array_join(names, ",").alias("controls"))
    return query


def _controls_sql(languages, pairs, column: str) -> str:
    return f"""WITH {lines_cte()}, {oracle.contexts_cte()}
        SELECT repo, path, n::BIGINT AS line_no, array_to_string({oracle._controls(column, pairs)}, ',') AS controls
        FROM ctx WHERE {in_list('language', languages)}"""


add("j_controls", _controls(rules.JAVA, fv.JAVA_CONTROLS, "code_context", "code"),
    _controls_sql(rules.JAVA, fv.JAVA_CONTROLS, "cctx"))
add("js_controls", _controls(rules.SCRIPT, fv.JS_CONTROLS, "raw_context", "raw"),
    _controls_sql(rules.SCRIPT, fv.JS_CONTROLS, "rctx"))

# --- enrichment and filters ------------------------------------------------------------------------


def _scan(options: ScanOptions = ScanOptions(), select=view) -> Query:
    return lambda s, sf: select(local_findings(corpus.files(s, sf), options))


_FLOW_VIEW = ("repo", "file_path", "rule_id", "id")


def _picked(*columns) -> Callable[[DataFrame], DataFrame]:
    """Columns by name, or as functions because a column needs a running session."""
    return lambda f: f.select(*_FLOW_VIEW, *[c() if callable(c) else c for c in columns])


add("scan_all", _scan(), findings_sql())
add("p_lang_filter", _scan(ScanOptions(Sources(languages=("go", "java")))),
    findings_sql(where="language IN ('go', 'java')"))
add("p_rule_family", _scan(select=_picked("rule_family")),
    findings_sql(columns="repo, file_path, rule_id, id, rule_family"))
add("p_parser_label", _scan(select=_picked("parser_used", "syntax_node_type")), findings_sql(columns=f"""
    repo, file_path, rule_id, id, CASE WHEN language = 'python' THEN 'python.ast' WHEN family = 'java'
    THEN {q(fv.JAVA_TEXTS['parser'])} WHEN family = 'script' THEN {q(fv.JS_TEXTS['parser'])} ELSE 'lexical' END AS parser_used,
    CASE WHEN language = 'python' THEN 'Module' ELSE syntax END AS syntax_node_type"""))
add("p_surface_flags", _scan(select=_picked("code_surface", lambda: flag("test_only"), "production_reachability")),
    findings_sql(columns="""repo, file_path, rule_id, id, code_surface, test_only::INT::BIGINT AS test_only,
    CASE WHEN test_only THEN 'test_only' ELSE 'production' END AS production_reachability"""))
add("p_detected", _scan(select=_picked(lambda: flag("source_detected"), lambda: flag("sink_detected"))), findings_sql(columns="""
    repo, file_path, rule_id, id, has_source::INT::BIGINT AS source_detected, has_sink::INT::BIGINT AS sink_detected"""))
add("p_flow", _scan(select=_picked("flow_status", lambda: F.col("evidence_level").cast("bigint").alias("evidence_level"))),
    findings_sql(columns="repo, file_path, rule_id, id, flow_status, evidence_level::BIGINT AS evidence_level"))
add("p_downgrade", _scan(select=_picked("classification", "verdict_candidate", "suggested_severity",
                                        lambda: joined("cwe_ids", "cwes"))),
    findings_sql(columns="""repo, file_path, rule_id, id, classification, verdict_candidate, suggested_severity,
    array_to_string(cwe_ids, ',') AS cwes"""))
_COMPLETE = ("source_identified", "sink_identified", "actual_invocation_confirmed", "production_surface",
             "runtime_dependency_remaining")
add("p_score", _scan(select=_picked(
    lambda: F.col("evidence_score").cast("bigint").alias("evidence_score"),
    *[lambda n=n: F.element_at("evidence_completeness", n).cast("int").cast("bigint").alias(n) for n in _COMPLETE])),
    findings_sql(columns="""repo, file_path, rule_id, id, least(100, confidence_score)::BIGINT AS evidence_score,
    has_source::INT::BIGINT AS source_identified, has_sink::INT::BIGINT AS sink_identified,
    invoked::INT::BIGINT AS actual_invocation_confirmed, (NOT test_only)::INT::BIGINT AS production_surface,
    (len(proof_gaps) > 0)::INT::BIGINT AS runtime_dependency_remaining"""))
_SECRET = "rule_id = 'WB.SECRET.HARDCODED'"
add("p_production_only", _scan(ScanOptions(kept=Kept(test_code="none"))), findings_sql(where="NOT test_only"))
add("p_test_filter", _scan(ScanOptions(kept=Kept(test_code="secrets"))),
    findings_sql(where=f"NOT test_only OR {_SECRET}"))


def _filtered_sql(condition: str) -> str:
    """A filter that comes before duplicates are removed: an earlier finding may survive."""
    ctes = findings_ctes().replace("        FROM final\n", f"        FROM final WHERE {condition}\n")
    return f"WITH {ctes} SELECT {oracle.VIEW} FROM findings"


_TYPES = ("review_point", "high_confidence_candidate")
add("p_result_types", _scan(ScanOptions(kept=Kept(verdicts=_TYPES))), _filtered_sql(in_list("verdict_candidate", _TYPES)))
add("p_min_evidence", _scan(ScanOptions(kept=Kept(evidence=2))), _filtered_sql("evidence_level >= 2"))
_LEVELS = ("high", "informational")
add("p_severities", _scan(ScanOptions(kept=Kept(severities=_LEVELS))), _filtered_sql(in_list("suggested_severity", _LEVELS)))
add("p_min_confidence", _scan(ScanOptions(kept=Kept(confidence=80))), _filtered_sql("confidence_score >= 80"))


def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    imported = results.semgrep(_semgrep_documents(spark, sf), "/work/app")
    kept = enrich.dedup(imported)
    return kept.select("repo", "rule_id", "file_path", F.col("start_line").cast("bigint").alias("start_line"), "id",
                       "description", F.col("emit_seq.file").alias("first_file"),
                       F.col("emit_seq.pos").cast("bigint").alias("first_pos"))


_DEDUP_SQL = """dedup AS (
    SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, start_line ORDER BY file DESC, event_id DESC) AS r,
           first_value(file) OVER k AS first_file, first_value(event_id % 50) OVER k AS first_pos
    FROM imported WINDOW k AS (PARTITION BY rule_id, file_path, start_line ORDER BY file, event_id))"""
_SEMGREP_SQL = f"{_events_sql()}, {_imported_sql('semgrep', 'severity', 'confidence', _CWE_SQL)}"
add("p_dedup", _dedup, f"""WITH {_SEMGREP_SQL}, {_DEDUP_SQL}
    SELECT repo, rule_id, file_path, start_line, id, description, first_file, first_pos::BIGINT AS first_pos
    FROM dedup WHERE r = 1""")


def _comments_only(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the corpus files that hold comments alone: there are none."""
    number = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long")
    return local_findings(corpus.files(spark, sf, "plain").filter(number % 9 == 0))


def _both_cases(judge: Callable[[DataFrame], DataFrame], name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cases = {"all files": local_findings(corpus.files(spark, sf)), "comments only": _comments_only(spark, sf)}
        rows = [judge(found).select(F.lit(case).alias("case"), flag(name)) for case, found in cases.items()]
        return rows[0].unionByName(rows[1])
    return run


def _both_cases_sql(condition: str, name: str) -> str:
    judged = f"coalesce(max(({condition})::INT), 0)::BIGINT AS {name}"
    return f"""WITH {findings_ctes()}, {findings_ctes(snapshot='plain', prefix='plain_')}
        SELECT 'all files' AS "case", {judged} FROM findings
        UNION ALL SELECT 'comments only', {judged} FROM plain_findings
        WHERE regexp_extract(file_path, '/f([0-9]+)[.]', 1)::BIGINT % 9 = 0"""


add("p_fail_on", _both_cases(lambda found: enrich.fail_on(found, "medium"), "failed"),
    _both_cases_sql("suggested_severity IN ('medium', 'critical')", "failed"))
_CANDIDATE = in_list("verdict_candidate", fv.CANDIDATE_VERDICTS)
_REVIEW = in_list("verdict_candidate", fv.REVIEW_VERDICTS)
add("p_review_exit", _both_cases(enrich.review_exit, "has_candidates"), _both_cases_sql(_CANDIDATE, "has_candidates"))
_NOMINAL = ScanOptions(kept=Kept(hidden=("suppressed", "informational_inventory", "review_point")))
add("p_nominal_filters", lambda s, sf: view(enrich.nominal_filters(local_findings(corpus.files(s, sf)), _NOMINAL)),
    findings_sql(where="verdict_candidate NOT IN ('suppressed', 'informational_inventory', 'review_point')"))

# --- inventory -------------------------------------------------------------------------------------


def _frameworks_sql(source: str) -> str:
    names = []
    for name, markers in fv.FRAMEWORK_MARKERS.items():
        test = " OR ".join(
            f"regexp_matches(text, {q('(?i)(?:^|[^A-Za-z0-9_])' + marker.replace('.', chr(92) + '.') + '(?:[^A-Za-z0-9_]|$)')})"
            for marker in markers)
        names.append(f"SELECT repo, {q(name)} AS framework FROM {source} GROUP BY repo HAVING bool_or({test})")
    return " UNION ALL ".join(names)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as files of the repository of their language."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select(F.regexp_extract("url", r"example\.com/([a-z]+)/", 1).alias("repo"), F.col("html").alias("text"))


add("d_frameworks", lambda s, sf: inventory.frameworks(
    corpus.files(s, sf).select("repo", "text").unionByName(_pages(s, sf))),
    f"""WITH t AS MATERIALIZED (SELECT repo, text FROM ({corpus.files_sql()}) UNION ALL
        SELECT regexp_extract(url, 'example\\.com/([a-z]+)/', 1), html FROM pages) {_frameworks_sql('t')}""")


def _component_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({column})', words)} THEN {q(name)}"
                              for name, words in fv.COMPONENT_KEYWORDS) + " END"


def _component_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    return docs.unionByName(corpus.files(spark, sf).select("repo", "path", "text"))


add("d_components", lambda s, sf: inventory.components(_component_files(s, sf)),
    f"""WITH t AS (SELECT lang AS repo, doc_id::VARCHAR AS path, text FROM documents UNION ALL
        SELECT repo, path, text FROM ({corpus.files_sql()})), c AS (SELECT repo, path, {_component_sql('text')} AS category FROM t)
        SELECT repo, path, category FROM c WHERE category IS NOT NULL""")


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    raw = listing(spark, sf)
    files = corpus.files(spark, sf)
    skipped = fs.skipped_files(fs.classify(raw))
    return inventory.inventory(files, raw, skipped, inventory.frameworks(files))


add("d_inventory", _inventory, f"""WITH {_listing_sql()}, {_reason_sql()}, {_MANIFESTS_SQL},
    f AS MATERIALIZED ({corpus.files_sql()}), skipped AS ({_SKIPPED_SQL}), fw AS ({_frameworks_sql('f')}),
    comp AS (SELECT repo, path, {_component_sql('text')} AS category FROM f)
    SELECT repo, 'languages' AS kind, language AS value, count(*) AS count FROM f GROUP BY repo, language UNION ALL
    SELECT repo, 'frameworks', framework, 1 FROM fw UNION ALL
    SELECT repo, 'dependency_manifests', path, 1 FROM mf UNION ALL
    SELECT repo, 'lock_files', path, 1 FROM mf WHERE {_LOCK} UNION ALL
    SELECT repo, 'build_files', path, 1 FROM mf WHERE {_BUILD} UNION ALL
    SELECT repo, 'deployment_files', path, 1 FROM named WHERE NOT is_symlink AND {_DEPLOY} UNION ALL
    SELECT repo, 'skipped_files', path, 1 FROM skipped UNION ALL
    SELECT repo, category, path, 1 FROM comp WHERE category IS NOT NULL""")


def _framework_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.files(spark, sf)
    kept = enrich.framework_filter(inventory.frameworks(files), ("Flask", "Express", "Axios"))
    found = enrich.with_framework(local_findings(files), kept)
    return found.select("repo", "file_path", "rule_id", "id", "framework")


add("p_framework_filter", _framework_filter, f"""WITH {findings_ctes()},
    fw AS ({_frameworks_sql('files')}),
    first AS (SELECT repo, min(framework) AS framework FROM fw WHERE framework IN ('Flask', 'Express', 'Axios') GROUP BY repo)
    SELECT f.repo, file_path, rule_id, id, CASE WHEN family = 'generic' AND rule_id <> {q(fv.AUTHZ_RULE[1])}
        THEN first.framework END AS framework
    FROM findings f LEFT JOIN first USING (repo)""")

# --- aggregations ------------------------------------------------------------------------------------


def _full(spark: SparkSession, sf: str, snapshot: str | None = None) -> DataFrame:
    return scan_files(corpus.files(spark, sf, snapshot))


def _scanned_once(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of ``_full`` that root causes and their lists read, written once: queries that read findings several times
    would scan the files as often."""
    path = f"{scratch(spark)}/findings"
    found = _full(spark, sf).select(
        "repo", "root_cause_id", "id", "title", "verdict_candidate", "file_path", "start_line", "sink", "related_callees",
        "related_routes", "proof_gaps", "counterevidence", "emit_seq")
    found.write.mode("overwrite").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


add("a_root_id", lambda s, sf: _full(s, sf).select("repo", "id", "rule_id", "file_path", "root_cause_id", "instance_of"),
    findings_sql(columns="repo, id, rule_id, file_path, root_cause_id, root_cause_id AS instance_of"))


def roots_view(roots: DataFrame) -> DataFrame:
    return roots.select("repo", "root_cause_id", "title", "root_cause_type", "instance_count",
                        F.col("canonical_location.file_path").alias("file_path"),
                        F.col("canonical_location.line").cast("bigint").alias("line"), "shared_sink", "shared_callee",
                        joined("related_routes"), joined("proof_gaps", by="|"), joined("counterevidence", by="|"))


_ROOTS_SQL = """
    root_first AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY repo, root_cause_id ORDER BY seq) = 1),
    root_texts AS (SELECT repo, root_cause_id, array_to_string(list_sort(list_distinct(flatten(list(proof_gaps)))), '|') AS gaps,
                          array_to_string(list_sort(list_distinct(flatten(list(counterevidence)))), '|') AS counters,
                          count(*) AS instance_count FROM findings GROUP BY ALL),
    roots AS (SELECT f.repo, f.root_cause_id, title, verdict_candidate AS root_cause_type, instance_count, file_path,
                     start_line::BIGINT AS line, coalesce(sink, '') AS shared_sink, '' AS shared_callee,
                     '' AS related_routes, gaps AS proof_gaps, counters AS counterevidence
              FROM root_first f JOIN root_texts USING (repo, root_cause_id))"""
add("a_correlate", lambda s, sf: roots_view(correlate.root_causes(_full(s, sf))),
    f"WITH {findings_ctes()}, {_ROOTS_SQL} SELECT * FROM roots")
add("a_instances", lambda s, sf: correlate.root_cause_instances(_full(s, sf)).select(
    "repo", "root_cause_id", "file_path", joined("instances"), "instance_count"),
    f"""WITH {findings_ctes()} SELECT repo, root_cause_id, file_path, string_agg(id, ',' ORDER BY seq) AS instances,
        count(*) AS instance_count FROM findings GROUP BY ALL""")
_SUMMARY_SQL = f"""count(DISTINCT repo || root_cause_id) AS root_causes, count(*) AS instances,
    count(*) FILTER ({_CANDIDATE}) AS candidate_findings, count(*) FILTER ({_REVIEW}) AS review_points,
    count(*) FILTER (test_only) AS test_only_items,
    count(*) FILTER (verdict_candidate = 'suppressed') AS suppressed_results,
    count(*) FILTER (flow_status = 'complete') AS complete_flows,
    count(*) FILTER (flow_status = 'partial') AS partial_flows,
    count(*) FILTER (flow_status = 'sink_only') AS sink_only"""
add("a_summaries", lambda s, sf: correlate.summaries(_full(s, sf)),
    f"WITH {findings_ctes()} SELECT {_SUMMARY_SQL} FROM findings")
add("a_languages", lambda s, sf: correlate.languages(corpus.files(s, sf)),
    f"SELECT language, count(*) AS files FROM ({corpus.files_sql()}) GROUP BY language")
add("a_counts_report", lambda s, sf: correlate.report_counts(_full(s, sf)),
    f"""WITH {findings_ctes()} SELECT count(DISTINCT repo || root_cause_id) AS root_causes, count(*) AS instances,
        count(*) FILTER (NOT {_REVIEW} AND verdict_candidate <> 'suppressed') AS review_leads,
        count(*) FILTER ({_REVIEW}) AS review_points FROM findings""")
add("a_stdout_summary", lambda s, sf: correlate.stdout_summary(corpus.files(s, sf), _full(s, sf), "corpus"),
    f"""WITH {findings_ctes()}, c AS (SELECT {_SUMMARY_SQL} FROM findings)
        SELECT '{{"target":"corpus","files":' || (SELECT count(*) FROM files) || ',"findings":' || instances ||
               ',"root_causes":' || root_causes || ',"instances":' || instances || ',"candidate_findings":' ||
               candidate_findings || ',"review_points":' || review_points || ',"test_only_items":' || test_only_items ||
               ',"suppressed_results":' || suppressed_results || ',"complete_flows":' || complete_flows ||
               ',"partial_flows":' || partial_flows || ',"sink_only":' || sink_only || '}}' AS summary FROM c""")


def _scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    classified = fs.classify(listing(spark, sf))
    return correlate.scan_counts(fs.source_files(classified), fs.skipped_files(classified))


add("a_scan_counts", _scan_counts, f"""WITH {_listing_sql()}, {_reason_sql()}
    SELECT (SELECT count(*) FROM ({_SCANNED_SQL})) AS files_scanned, (SELECT count(*) FROM ({_SKIPPED_SQL})) AS files_skipped""")

# --- code graph -------------------------------------------------------------------------------------

_DECLARED = "CASE " + " ".join(
    f"WHEN language = {q(name)} THEN nullif({oracle.x('raw', regex, 1)}, '')"
    for name, (regex, _) in fv.DECLARATIONS.items()) + " END"
_CALLS = (r"list_filter(list_transform(regexp_extract_all(raw, '([\p{L}\p{N}_$]+)\s*\(', 1), "
          r"lambda c: ltrim(c, '$')), lambda c: regexp_matches(c, '^[A-Za-z_]'))")


def _graph_sql() -> str:
    return f"""{lines_cte()},
    decl AS (SELECT repo, path, language, n, raw, {_DECLARED} AS name FROM lines),
    located AS MATERIALIZED (SELECT repo, path, language, n, raw, name,
             last_value(name IGNORE NULLS) OVER w AS symbol,
             last_value(CASE WHEN name IS NOT NULL THEN n END IGNORE NULLS) OVER w AS symbol_line
             FROM decl WINDOW w AS (PARTITION BY repo, path ORDER BY n ROWS UNBOUNDED PRECEDING)),
    called AS (SELECT repo, path, symbol, symbol_line, n, unnest({_CALLS}) AS callee,
                      unnest(range(len({_CALLS}))) AS k FROM located WHERE symbol IS NOT NULL),
    edges AS MATERIALIZED (SELECT repo, path, symbol, symbol_line, callee, min(n * 100000 + k) AS pos FROM called
              WHERE callee <> symbol GROUP BY ALL)"""


add("g_symbols", lambda s, sf: graph.symbols(corpus.files(s, sf)).select(
    "repo", "path", "name", F.col("line_no").cast("bigint").alias("line_no"), "kind"),
    f"""WITH {_graph_sql()} SELECT repo, path, name, n::BIGINT AS line_no,
        CASE WHEN language = 'java' THEN 'method' ELSE 'function' END AS kind FROM decl WHERE name IS NOT NULL""")
add("g_calls", lambda s, sf: graph.call_edges(corpus.files(s, sf)).select(
    "repo", "path", "caller", F.col("caller_line").cast("bigint").alias("caller_line"), "callee",
    F.col("ord").cast("bigint").alias("ord")),
    f"""WITH {_graph_sql()} SELECT repo, path, symbol AS caller, symbol_line::BIGINT AS caller_line, callee,
        (row_number() OVER (PARTITION BY repo, path, symbol_line ORDER BY pos) - 1)::BIGINT AS ord FROM edges""")
add("g_symbol_at", lambda s, sf: graph.symbol_at(corpus.files(s, sf)).select(
    "repo", "path", F.col("line_no").cast("bigint").alias("line_no"), "raw", "symbol",
    F.col("symbol_line").cast("bigint").alias("symbol_line")),
    f"""WITH {_graph_sql()} SELECT repo, path, n::BIGINT AS line_no, raw, symbol, symbol_line::BIGINT AS symbol_line
        FROM located""")
add("g_callers", lambda s, sf: graph.callers(graph.symbols(corpus.files(s, sf))),
    f"WITH {_graph_sql()} SELECT DISTINCT repo, callee AS name, symbol AS caller FROM edges")
add("g_routes", lambda s, sf: graph.graph_routes(corpus.files(s, sf)).withColumn(
    "line_no", F.col("line_no").cast("bigint")),
    f"""WITH {_graph_sql()} SELECT repo, path, n::BIGINT AS line_no, upper({oracle.x('raw', fv.GRAPH_ROUTE, 1)}) AS method,
        {oracle.x('raw', fv.GRAPH_ROUTE, 2)} AS route, symbol AS handler FROM located WHERE {oracle.m('raw', fv.GRAPH_ROUTE)}""")


def _route_sql(group: int, mapping: str) -> str:
    m, x = oracle.m, oracle.x
    return f"""CASE WHEN {m('raw', fv.ROUTE_DECORATOR)} THEN {x('raw', fv.ROUTE_DECORATOR, group)}
        WHEN {m('raw', fv.ROUTE_METHOD)} THEN {x('raw', fv.ROUTE_METHOD, group)}
        WHEN {m('raw', fv.ROUTE_JAVA)} THEN {mapping} END"""


def _routes_sql() -> str:
    return f"""{_graph_sql()}, fw AS ({_frameworks_sql('files')}),
    routed AS MATERIALIZED (SELECT repo, path, n::BIGINT AS line_no, symbol, symbol_line, raw,
        upper({_route_sql(1, "'MAPPING'")}) AS method, {_route_sql(2, oracle.x('raw', fv.ROUTE_JAVA, 1))} AS route,
        regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS evidence
        FROM located WHERE {any_of('raw', fv.ROUTE_MARKERS)}),
    routes AS (SELECT r.*, (SELECT min(framework) FROM fw WHERE fw.repo = r.repo
                            AND contains(lower(r.raw), lower(fw.framework))) AS framework FROM routed r)"""


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.files(spark, sf)
    return graph.route_inventory(files, inventory.frameworks(files)).select(
        "repo", "path", F.col("line_no").cast("bigint").alias("line_no"), "method", "route", "framework", "evidence",
        "review_notes", joined("roles"))


add("g_route_inventory", _routes, f"""WITH {_routes_sql()} SELECT repo, path, line_no, method, route, framework, evidence,
    {q(fv.ROUTE_NOTES)} AS review_notes, '' AS roles FROM routes""")


def _enriched_routes(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.files(spark, sf)
    stored = graph.write_graph(files, f"{scratch(spark)}/graph")
    return graph.enrich_routes(stored, inventory.frameworks(files)).select(
        "repo", "path", F.col("line_no").cast("bigint").alias("line_no"), "method", "route", "framework", "handler",
        joined("related_callees"), "caller_count", "graph_scope")


add("g_enrich_route", _enriched_routes, f"""WITH {_routes_sql()},
    callees AS (SELECT repo, path, symbol_line, string_agg(callee, ',' ORDER BY callee) AS related_callees FROM edges GROUP BY ALL),
    callers AS (SELECT repo, callee AS handler, count(DISTINCT symbol) AS caller_count FROM edges GROUP BY ALL)
    SELECT r.repo, r.path, line_no, method, route, framework, symbol AS handler,
           coalesce(related_callees, '') AS related_callees,
           coalesce(caller_count, 0) AS caller_count,
           CASE WHEN symbol IS NULL THEN {q(fv.SCOPE_SYNTAX)} ELSE {q(fv.SCOPE_GRAPH)} END AS graph_scope
    FROM routes r LEFT JOIN callees c ON c.repo = r.repo AND c.path = r.path AND c.symbol_line = r.symbol_line
    LEFT JOIN callers k ON k.repo = r.repo AND k.handler = r.symbol""")
add("g_route_callers", lambda s, sf: graph.route_callers(graph.write_graph(corpus.files(s, sf), f"{scratch(s)}/graph")), f"""WITH {_routes_sql()}
    SELECT DISTINCT e.repo, callee AS handler, e.symbol AS caller FROM edges e
    WHERE EXISTS (SELECT 1 FROM routes r WHERE r.repo = e.repo AND r.symbol = e.callee)""")

# --- comparison -------------------------------------------------------------------------------------


def _two(function) -> Query:
    return lambda s, sf: function(_full(s, sf, "old"), _full(s, sf, "new"))


def _two_sql() -> str:
    return f"{findings_ctes(snapshot='old', prefix='o_')}, {findings_ctes(snapshot='new', prefix='n_')}"


add("cmp_counts", _two(compare.counts), f"""WITH {_two_sql()}
    SELECT (SELECT count(*) FROM o_findings) AS old_instances, (SELECT count(*) FROM n_findings) AS new_instances,
           (SELECT count(DISTINCT repo || id) FROM n_findings n WHERE NOT EXISTS
               (SELECT 1 FROM o_findings o WHERE o.repo = n.repo AND o.id = n.id)) AS added,
           (SELECT count(DISTINCT repo || id) FROM o_findings o WHERE NOT EXISTS
               (SELECT 1 FROM n_findings n WHERE o.repo = n.repo AND o.id = n.id)) AS removed""")
add("cmp_changes", _two(compare.changes), f"""WITH {_two_sql()}
    SELECT o.repo, o.id, o.classification AS old_classification, n.classification AS new_classification
    FROM o_findings o JOIN n_findings n ON o.repo = n.repo AND o.id = n.id
    WHERE o.classification IS DISTINCT FROM n.classification""")


def _written_runs(function) -> Query:
    """A comparison of two runs that lie in buckets."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        base = scratch(spark)
        for snapshot in ("old", "new"):
            runs.write_run(_full(spark, sf, snapshot), f"{base}/{snapshot}", 32)
        return function(*[runs.read_run(spark, f"{base}/{snapshot}") for snapshot in ("old", "new")])
    return query


add("cmp_counts_written", _written_runs(compare.run_counts), ORACLE["cmp_counts"])
add("cmp_changes_written", _written_runs(compare.run_changes), ORACLE["cmp_changes"])


def _unreported(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.files(spark, sf, "plain")
    return compare.unreported(files, local_findings(files))


_SENSITIVE = "|".join(fv.SAMPLE_KEYWORDS)
add("cmp_unreported", _unreported, f"""WITH {findings_ctes(snapshot="plain")}
    SELECT repo, path AS file_path, {q(fv.SAMPLE_REASON)} AS reason FROM files f
    WHERE regexp_matches(lower(path) || chr(10) || lower(text), '{_SENSITIVE}')
      AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.repo = f.repo AND g.file_path = f.path)
    ORDER BY path, repo LIMIT {fv.SAMPLE_FILES}""")


def _handoff(spark: SparkSession, sf: str) -> DataFrame:
    found = _scanned_once(spark, sf)
    return compare.handoff(correlate.root_causes(found), found).drop("emit_seq")


add("cmp_handoff", _handoff, f"""WITH {findings_ctes()}, {_ROOTS_SQL}
    SELECT repo, root_cause_id, CASE WHEN root_cause_type IN ('high_confidence_candidate', 'confirmed_static_evidence')
        THEN 'high' ELSE 'normal' END AS priority, f.id AS finding_id, f.file_path AS path,
        {q(fv.HANDOFF_REASON)} AS reason
    FROM findings f JOIN roots r USING (repo, root_cause_id)""")
add("cmp_handoff_flat", lambda s, sf: compare.handoff_flat(_full(s, sf)).select(
    "repo", "finding_id", "file_path", joined(F.col("line_range").cast("array<string>"), "line_range"),
    joined("related_callers_or_callees"), joined("related_security_components"), "reason", joined("proof_gaps"),
    joined("counterevidence"), joined("minimum_context_required")),
    findings_sql(columns=f"""repo, id AS finding_id, file_path, start_line || ',' || start_line AS line_range,
    '' AS related_callers_or_callees, '' AS related_security_components, {q(fv.HANDOFF_FLAT_REASON)} AS reason,
    array_to_string(proof_gaps, ',') AS proof_gaps, array_to_string(counterevidence, ',') AS counterevidence,
    {q(','.join(fv.HANDOFF_CONTEXT))} AS minimum_context_required"""))


def _summary_join(spark: SparkSession, sf: str) -> DataFrame:
    found = _scanned_once(spark, sf)
    return compare.summary_locations(correlate.root_causes(found), found)


add("cmp_summary_join", _summary_join, f"""WITH {findings_ctes()}, {_ROOTS_SQL}
    SELECT DISTINCT repo, root_cause_id, f.file_path || ':' || f.start_line AS location, r.title, r.root_cause_type,
           r.instance_count
    FROM findings f JOIN roots r USING (repo, root_cause_id)
    WHERE r.root_cause_type NOT IN ('review_point', 'informational_inventory')""")


def _import_union(spark: SparkSession, sf: str) -> DataFrame:
    imported = results.semgrep(_semgrep_documents(spark, sf), "/work/app")
    found = scan_files(corpus.files(spark, sf), imported=imported)
    return found.select("repo", "id", "rule_id", "file_path", F.col("start_line").cast("bigint").alias("start_line"),
                        "verdict_candidate", "root_cause_id")


add("cmp_import_union", _import_union, f"""WITH {findings_ctes()}, {_SEMGREP_SQL}, {_DEDUP_SQL}
    SELECT repo, id, rule_id, file_path, start_line::BIGINT AS start_line, verdict_candidate, root_cause_id
    FROM findings UNION ALL
    SELECT repo, id, rule_id, file_path, start_line, verdict_candidate,
           'RC-' || upper(substr(sha256(rule_id || '|' || sink || '||'), 1, 12)) FROM dedup WHERE r = 1""")

# --- sinks ----------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = f"{scratch(spark)}/{name}"
    df.write.mode("overwrite").json(path)
    return path


def _out_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings as JSON lines, written, read back."""
    path = f"{scratch(spark)}/findings"
    reports.finding_records(_full(spark, sf)).select("repo", "value").write.mode("overwrite").parquet(path)
    fields = "id string, rule_id string, file_path string, start_line bigint, evidence string, cwe_ids array<string>"
    rows = spark.read.parquet(path).select("repo", F.from_json("value", fields).alias("f"))
    return rows.select("repo", "f.id", "f.rule_id", "f.file_path", "f.start_line", "f.evidence",
                       F.array_join("f.cwe_ids", ",").alias("cwes"))


add("out_findings", _out_findings, findings_sql(columns="""repo, id, rule_id, file_path, start_line::BIGINT AS start_line,
    evidence, array_to_string(cwe_ids, ',') AS cwes"""))


def _out_root_causes(spark: SparkSession, sf: str) -> DataFrame:
    roots = correlate.root_causes(_full(spark, sf))
    return roots_view(spark.read.schema(roots.schema).json(_stored(spark, roots, "roots")))


add("out_root_causes", _out_root_causes, f"WITH {findings_ctes()}, {_ROOTS_SQL} SELECT * FROM roots")
add("out_review_points", lambda s, sf: view(reports.review_points(local_findings(corpus.files(s, sf)))),
    findings_sql(where=_REVIEW))


def _out_inventory(spark: SparkSession, sf: str) -> DataFrame:
    table = _inventory(spark, sf)
    path = f"{scratch(spark)}/inventory"
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


add("out_inventory", _out_inventory, ORACLE["d_inventory"])
add("out_sarif", lambda s, sf: reports.sarif_results(_full(s, sf)).select(
    "repo", "ruleId", "level", F.col("message.text").alias("message"),
    F.col("properties.verdict_candidate").alias("verdict"), F.col("properties.code_surface").alias("surface"),
    F.col("properties.source").alias("source"), F.col("properties.sink").alias("sink"),
    F.array_join("properties.proof_gaps", ",").alias("proof_gaps"),
    F.col("properties.exact_invoked_api").alias("api"),
    F.get("locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
    F.get("locations", F.lit(0))["physicalLocation"]["region"]["startLine"].cast("bigint").alias("start_line")),
    findings_sql(columns="""repo, rule_id AS "ruleId", CASE WHEN suggested_severity IN ('high', 'critical') THEN 'error'
    ELSE 'warning' END AS level, title || ': ' || description AS message, verdict_candidate AS verdict,
    code_surface AS surface, source, sink, array_to_string(proof_gaps, ',') AS proof_gaps, exact_invoked_api AS api,
    file_path AS uri, start_line::BIGINT AS start_line"""))
_BLOCK_SQL = r"""'### ' || title || chr(10) || '- **Severity:** ' || suggested_severity || ' | **Type:** ' || verdict_candidate ||
    ' | **Confidence:** ' || confidence_score || chr(10) || '- **Location:** `' || file_path || ':' || start_line ||
    '` | **Root cause:** `' || root_cause_id || '`' || chr(10) || '- **Rule:** `' || rule_id || '` | **Code surface:** `' ||
    code_surface || '` | **Flow:** `' || flow_status || '`' || chr(10) || '- **Why raised:** ' || description || chr(10) ||
    '- **Source → sink:** `' || coalesce(nullif(source, ''), 'unknown') || '` → `' || coalesce(nullif(sink, ''), 'unknown') ||
    '`' || chr(10) || '- **Observed controls:** ' || coalesce(nullif(array_to_string(controls, ', '), ''), 'None observed.') ||
    chr(10) || '- **Proof gaps:** ' || coalesce(nullif(array_to_string(proof_gaps, ', '), ''), 'None recorded.') || chr(10) ||
    '- **Counterevidence:** ' || coalesce(nullif(array_to_string(counterevidence, ', '), ''), 'None recorded.') || chr(10) ||
    '- **Reviewer action:** ' || coalesce(verify[1], 'Trace the surrounding source-to-sink flow.') || chr(10) ||
    '- **Evidence:**' || chr(10) || '```text' || chr(10) ||
    coalesce(nullif(replace(evidence, '```', '``' || chr(8203) || '`'), ''), 'No snippet available.') || chr(10) || '```' || chr(10)"""
add("out_report", lambda s, sf: reports.report_blocks(_full(s, sf)).select("repo", "section", "file_path", "block"),
    findings_sql(columns=f"""repo, CASE WHEN {_REVIEW} THEN 'Review points' ELSE 'Candidate review leads' END AS section,
    file_path, {_BLOCK_SQL} AS block""", where="verdict_candidate <> 'suppressed'"))
add("out_report_simple", lambda s, sf: reports.simple_report(_full(s, sf)).select("repo", "block"),
    findings_sql(columns="""repo, '## ' || title || chr(10) || '- Rule: `' || rule_id || '`' || chr(10) ||
    '- Classification: `' || classification || '`' || chr(10) || '- Severity: `' || suggested_severity || '`' || chr(10) ||
    '- Location: `' || file_path || ':' || start_line || '`' || chr(10) || '- Verification: ' ||
    CASE WHEN len(verify) = 0 THEN '[]' ELSE '[''' || array_to_string(verify, ''', ''') || ''']' END || chr(10) AS block"""))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    found = _scanned_once(spark, sf)
    roots = reports.summary_root_causes(correlate.root_causes(found), found)
    return roots.select("repo", "value").unionByName(reports.summary_review_points(found).select("repo", "value"))


add("out_summary", _summary, f"""WITH {findings_ctes()}, {_ROOTS_SQL},
    kept AS (SELECT * FROM roots WHERE root_cause_type NOT IN ('review_point', 'informational_inventory'))
    SELECT repo, '- `' || root_cause_id || '` — ' || title || ' (' || root_cause_type || '; ' || instance_count ||
           ' related instances)' AS value FROM kept UNION ALL
    SELECT DISTINCT_ROWS.repo, '  - Review location: `' || location || '`' FROM (
        SELECT DISTINCT f.repo, f.root_cause_id, f.file_path || ':' || f.start_line AS location
        FROM findings f JOIN kept USING (repo, root_cause_id)) AS DISTINCT_ROWS UNION ALL
    SELECT repo, '- `' || id || '` — ' || title || ' — `' || file_path || ':' || start_line || '`' FROM findings WHERE {_REVIEW}""")



def _kept_findings(spark: SparkSession, sf: str, compression: str = "snappy") -> tuple[DataFrame, DataFrame, str]:
    """Findings and root causes of the corpus as written tables, and the folder they lie in."""
    path = scratch(spark)
    found = _full(spark, sf)
    found.write.mode("overwrite").option("compression", compression).parquet(f"{path}/findings")
    stored = spark.read.schema(FINDINGS).parquet(f"{path}/findings")
    roots = correlate.root_causes(stored)
    roots.write.mode("overwrite").parquet(f"{path}/root_causes")
    return stored, spark.read.schema(roots.schema).parquet(f"{path}/root_causes"), path


def _report_document(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every repository's report as it lies in its files."""
    found, roots, path = _kept_findings(spark, sf, "zstd")
    docs.write_documents(docs.report_pieces(found, roots, corpus.files(spark, sf)), f"{path}/report", compression="gzip")
    return docs.numbered_lines(docs.read_documents(spark, f"{path}/report"))


def _summary_document(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every repository's summary as it lies in its files."""
    found, roots, path = _kept_findings(spark, sf)
    files = corpus.files(spark, sf)
    pieces = docs.summary_pieces(found, roots, files, inventory.frameworks(files), "corpus")
    docs.write_documents(pieces, f"{path}/summary")
    return docs.numbered_lines(docs.read_documents(spark, f"{path}/summary"))


def _sarif_log(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every repository's SARIF log as it lies in its files; results are parsed from their text."""
    found, _, path = _kept_findings(spark, sf)
    docs.write_documents(docs.sarif_pieces(found, "scan", "1", corpus.files(spark, sf)), f"{path}/sarif", compression="gzip")
    lines = docs.numbered_lines(docs.read_documents(spark, f"{path}/sarif"))
    result = F.parse_json(F.regexp_replace("line", "^,", ""))

    def field(place: str, kind: str = "string"):
        return F.when(F.col("line").rlike('^,?\\{"ruleId"'), F.try_variant_get(result, place, kind))

    return lines.select(
        "repo", "line_no", F.col("line").startswith(",").cast("bigint").alias("comma"),
        F.when(field("$.ruleId").isNull(), F.col("line")).alias("frame"),
        field("$.ruleId").alias("rule_id"), field("$.level").alias("level"), field("$.message.text").alias("message"),
        field("$.properties.verdict_candidate").alias("verdict"), field("$.properties.sink").alias("sink"),
        field("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
        field("$.locations[0].physicalLocation.region.startLine", "bigint").alias("start_line"))


def _document_sql(pieces: str, columns: str = "repo, line_no, line") -> str:
    """Lines of documents made from pieces (repo, part, descending, place, line, seq, value)."""
    return f"""pieces AS ({pieces}),
    whole AS (SELECT repo, string_split(string_agg(value, chr(10) ORDER BY part, descending, place, line, seq), chr(10)) AS lines
              FROM pieces GROUP BY repo),
    numbered AS (SELECT repo, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM whole)
    SELECT {columns} FROM numbered"""


_REPOS_SQL = f"""all_repos AS (SELECT DISTINCT coalesce(repo, '') AS repo FROM ({corpus.files_sql()})),
    tally AS (SELECT a.repo, count(DISTINCT root_cause_id) AS root_causes, count(f.repo) AS instances,
                     count(f.repo) FILTER (NOT {_REVIEW} AND verdict_candidate <> 'suppressed') AS leads,
                     count(f.repo) FILTER ({_REVIEW}) AS points
              FROM all_repos a LEFT JOIN findings f ON coalesce(f.repo, '') = a.repo GROUP BY a.repo)"""
_COUNTS_TEXT = """'Root causes: ' || root_causes || ' | Instances: ' || instances || ' | Review leads: ' || leads ||
    ' | Review points: ' || points || chr(10)"""
add("out_report_document", _report_document, f"""WITH {findings_ctes()}, {_ROOTS_SQL}, {_REPOS_SQL},
    """ + _document_sql(f"""
    SELECT repo, 0 AS part, 0 AS descending, '' AS place, 0 AS line, '' AS seq,
           {q(fv.REPORT_TITLE)} || chr(10) || chr(10) || {q(fv.REPORT_INTRO)} || chr(10) || chr(10) || {_COUNTS_TEXT} AS value FROM tally
    UNION ALL SELECT repo, 1, 0, '', 0, '', '## Candidate review leads' || chr(10) FROM tally
    UNION ALL SELECT repo, 3, 0, '', 0, '', '## Review points' || chr(10) FROM tally
    UNION ALL SELECT repo, 5, 0, '', 0, '', '## Root causes' FROM tally
    UNION ALL SELECT coalesce(repo, ''), CASE WHEN {_REVIEW} THEN 4 ELSE 2 END, -confidence_score, file_path, start_line, seq,
              {_BLOCK_SQL} FROM findings WHERE verdict_candidate <> 'suppressed'
    UNION ALL SELECT coalesce(repo, ''), 6, 0, root_cause_id, 0, '', chr(10) || '- `' || root_cause_id || '`: ' || title || ' (' ||
              instance_count || ' instances)' FROM roots"""))
_FACTS_SQL = """facts AS (SELECT t.*,
        (SELECT string_agg(DISTINCT language, ', ' ORDER BY language) FROM fl WHERE coalesce(fl.repo, '') = t.repo) AS languages,
        (SELECT string_agg(DISTINCT framework, ', ' ORDER BY framework) FROM fw WHERE coalesce(fw.repo, '') = t.repo) AS frameworks
    FROM tally t)"""
add("out_summary_document", _summary_document, f"""WITH {findings_ctes()}, {_ROOTS_SQL}, {_REPOS_SQL},
    fl AS MATERIALIZED ({corpus.files_sql()}), fw AS ({_frameworks_sql('fl')}), {_FACTS_SQL},
    kept AS (SELECT * FROM roots WHERE root_cause_type NOT IN ('review_point', 'informational_inventory')),
    places AS (SELECT DISTINCT f.repo, f.root_cause_id, f.file_path || ':' || f.start_line AS location
               FROM findings f JOIN kept k ON f.repo IS NOT DISTINCT FROM k.repo AND f.root_cause_id = k.root_cause_id),
    sized AS (SELECT *, count(*) OVER (PARTITION BY repo, root_cause_id) AS size FROM places),
    """ + _document_sql(f"""
    SELECT repo, 0 AS part, 0 AS descending, '' AS place, 0 AS line, '' AS seq, concat_ws(chr(10), {q(fv.SUMMARY_TITLE)}, '',
           {q(fv.SUMMARY_INTRO)}, '', '## Repository', '', '- Path: `corpus/' || repo || '`', '- Languages: ' || coalesce(languages, ''),
           '- Frameworks: ' || coalesce(frameworks, ''), '- Instances: ' || instances, '- Root causes: ' || root_causes, '',
           '## Scope', '', {', '.join(q('- ' + line) for line in fv.SUMMARY_SCOPE)}, '', '## Candidate root causes', '') AS value
    FROM facts
    UNION ALL SELECT coalesce(repo, ''), 1, 0, root_cause_id, 0, '', '- `' || root_cause_id || '` — ' || title || ' (' || root_cause_type ||
              '; ' || instance_count || ' related instances)' FROM kept
    UNION ALL SELECT coalesce(repo, ''), 1, 0, root_cause_id, 1, '', '  - Review locations: `' || string_agg(location, '`, `' ORDER BY location) || '`'
              FROM sized WHERE size <= {docs.PLACES_A_LINE} GROUP BY repo, root_cause_id
    UNION ALL SELECT coalesce(repo, ''), 1, 0, root_cause_id, 1, location, '  - Review locations: `' || location || '`'
              FROM sized WHERE size > {docs.PLACES_A_LINE}
    UNION ALL SELECT repo, 2, 0, '', 0, '', chr(10) || '## Review points' || chr(10) FROM tally
    UNION ALL SELECT coalesce(repo, ''), 3, 0, '', 0, seq, '- `' || id || '` — ' || title || ' — `' || file_path || ':' || start_line || '`'
              FROM findings WHERE {_REVIEW}
    UNION ALL SELECT repo, 4, 0, '', 0, '', concat_ws(chr(10), '', {q(fv.SUMMARY_RETAINED)}, '', '## Limitations', '',
              {q(fv.SUMMARY_LIMITS)}, '') FROM tally"""))
_SARIF_HEAD = (f'{{"$schema":"{fv.SARIF_SCHEMA}","version":"{fv.SARIF_VERSION}","runs":[{{"tool":{{"driver":'
               '{"name":"scan","version":"1"}},"results":[')
add("out_sarif_log", _sarif_log, f"""WITH {findings_ctes()}, {_REPOS_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(repo, '') ORDER BY seq) AS k FROM findings)
    SELECT coalesce(repo, '') AS repo, k + 1 AS line_no, (k > 1)::INT::BIGINT AS comma, NULL AS frame, rule_id,
           CASE WHEN suggested_severity IN ('high', 'critical') THEN 'error' ELSE 'warning' END AS level,
           title || ': ' || description AS message, verdict_candidate AS verdict, sink, file_path AS uri,
           start_line::BIGINT AS start_line FROM ranked
    UNION ALL SELECT repo, 1, 0, {q(_SARIF_HEAD)} || CASE WHEN instances = 0 THEN ']}}]}}' ELSE '' END,
              NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tally
    UNION ALL SELECT repo, instances + 2, 0, ']}}]}}', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tally WHERE instances > 0""")


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    classified = fs.classify(listing(spark, sf))
    files = fs.source_files(classified)
    row = reports.metadata(files, fs.skipped_files(classified), inventory.frameworks(corpus.files(spark, sf)), "corpus",
                           ScanOptions())
    languages = F.transform("languages", lambda e: F.concat_ws("=", e["language"], e["n"].cast("string")))
    return row.select("target", "files_scanned", "files_skipped", F.array_join(languages, ",").alias("languages"),
                      joined("frameworks"))


add("out_metadata", _metadata, f"""WITH {_listing_sql()}, {_reason_sql()}, scanned AS ({_SCANNED_SQL}),
    skipped AS ({_SKIPPED_SQL}), f AS MATERIALIZED ({corpus.files_sql()}), fw AS ({_frameworks_sql('f')}),
    l AS (SELECT language, count(*) AS n FROM scanned GROUP BY language)
    SELECT 'corpus' AS target, (SELECT count(*) FROM scanned) AS files_scanned, (SELECT count(*) FROM skipped) AS files_skipped,
           (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM l) AS languages,
           (SELECT string_agg(DISTINCT framework, ',' ORDER BY framework) FROM fw) AS frameworks""")


def _out_errors(spark: SparkSession, sf: str) -> DataFrame:
    errors = _import_errors(spark, sf)
    return spark.read.schema(errors.schema).json(_stored(spark, errors, "errors"))


add("out_errors", _out_errors, ORACLE["imp_errors"])


def _out_context(spark: SparkSession, sf: str) -> DataFrame:
    requests = _handoff(spark, sf)
    return spark.read.schema(requests.schema).json(_stored(spark, requests, "requests"))


add("out_context_request", _out_context, ORACLE["cmp_handoff"])
