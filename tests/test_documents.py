"""Documents of repositories: text held against hand-made documents, order over many files."""

import json

from pyspark.sql import functions as F

from codetrawl import scan_files
from codetrawl import fixed_values as fv
from codetrawl.operators import correlate
from codetrawl.plans import documents, reports


def read(spark, path):
    """Each repository's document: its files one after the other by name."""
    out = {}
    for row in sorted(documents.read_documents(spark, str(path)).collect(), key=lambda r: (r.repo, r.file)):
        out[row.repo] = out.get(row.repo, "") + row.text
    return out


def finding(repo, place, verdict="secure_coding_concern", confidence=80, evidence="x = 1", **more):
    file, line = place.split(":")
    row = {"repo": repo, "file_path": file, "start_line": int(line), "verdict_candidate": verdict, "confidence_score": confidence,
           "evidence": evidence, "id": f"id-{place}", "title": "T", "description": "D", "rule_id": "R.1", "suggested_severity": "high",
           "code_surface": "backend", "flow_status": "sink_only", "source": None, "sink": "s", "observed_controls": [],
           "proof_gaps": ["a", "b"], "counterevidence": [], "recommended_verification_steps": [], "root_cause_id": "RC-1"}
    return row | more


def table(spark, rows):
    from codetrawl.schema import FINDINGS, FINDING_DEFAULTS

    full = []
    for number, row in enumerate(rows):
        values = FINDING_DEFAULTS | {"emit_seq": (0, row["file_path"], 0, row["start_line"], number)} | row
        full.append([list(values[f.name]) if isinstance(values[f.name], tuple) and f.name != "emit_seq" else values[f.name]
                     for f in FINDINGS.fields])
    return spark.createDataFrame(full, FINDINGS)


BLOCK = """### T
- **Severity:** high | **Type:** {verdict} | **Confidence:** {confidence}
- **Location:** `{place}` | **Root cause:** `{root}`
- **Rule:** `R.1` | **Code surface:** `backend` | **Flow:** `sink_only`
- **Why raised:** D
- **Source → sink:** `unknown` → `s`
- **Observed controls:** None observed.
- **Proof gaps:** a, b
- **Counterevidence:** None recorded.
- **Reviewer action:** Trace the surrounding source-to-sink flow.
- **Evidence:**
```text
{evidence}
```
"""


def test_report_equals_a_document_made_by_hand(spark, tmp_path):
    found = table(spark, [
        finding("007", "b.py:2"), finding("007", "a.py:10", evidence="``` x"), finding("007", "a.py:9", confidence=90),
        finding("007", "c.py:1", "review_point", 10, "", root_cause_id="RC-2"),
        finding("007", "d.py:1", "suppressed", root_cause_id="RC-1"), finding(None, "z.py:1"),
    ])
    repos = spark.createDataFrame([("007",), (None,), ("empty",)], "repo string")
    documents.write_documents(documents.report_pieces(found, correlate.root_causes(found), repos), str(tmp_path / "r"), 2)
    got = read(spark, tmp_path / "r")
    top = f"{fv.REPORT_TITLE}\n\n{fv.REPORT_INTRO}\n\n"

    def block(place, verdict="secure_coding_concern", confidence=80, evidence="x = 1", root="RC-1"):
        return BLOCK.format(place=place, verdict=verdict, confidence=confidence, evidence=evidence, root=root) + "\n"

    assert got["007"] == (
        top + "Root causes: 2 | Instances: 5 | Review leads: 3 | Review points: 1\n\n## Candidate review leads\n\n"
        + block("a.py:9", confidence=90) + block("a.py:10", evidence="``​` x") + block("b.py:2") + "## Review points\n\n"
        + block("c.py:1", "review_point", 10, "No snippet available.", "RC-2")
        + "## Root causes\n\n- `RC-1`: T (4 instances)\n\n- `RC-2`: T (1 instances)\n")
    assert got["empty"] == (top + "Root causes: 0 | Instances: 0 | Review leads: 0 | Review points: 0\n\n"
                            "## Candidate review leads\n\n## Review points\n\n## Root causes\n")
    assert got[""].count("### T") == 1 and set(got) == {"007", "empty", ""}
    # the offsets of the files make up the same document
    for repo in got:
        rows = sorted((r for r in documents.offsets(spark, str(tmp_path / "r")).collect() if r.repo == repo), key=lambda r: r.file)
        assert [r.first_byte for r in rows] == [sum(x.bytes for x in rows[:i]) for i in range(len(rows))]
        assert sum(r.bytes for r in rows) == len(got[repo].encode())
    assert len([r for r in documents.offsets(spark, str(tmp_path / "r")).collect() if r.repo == "007"]) >= 5
    lines = documents.numbered_lines(documents.read_documents(spark, str(tmp_path / "r"))).filter("repo = '007'").orderBy("line_no")
    assert [r.line for r in lines.collect()] == got["007"][:-1].split("\n")


def test_summary_equals_a_document_made_by_hand(spark, tmp_path):
    found = table(spark, [
        finding("r", "b.py:2"), finding("r", "a.py:10"), finding("r", "a.py:10", root_cause_id="RC-0", id="other"),
        finding("r", "c.py:1", "review_point", root_cause_id="RC-2")])
    files = spark.createDataFrame([("r", "python"), ("r", "go"), ("r", "go"), ("e", "java")], "repo string, language string")
    frameworks = spark.createDataFrame([("r", "Flask"), ("r", "Django")], "repo string, framework string")

    def text(places_a_line, name):
        pieces = documents.summary_pieces(found, correlate.root_causes(found), files, frameworks, "/data/", places_a_line)
        documents.write_documents(pieces, str(tmp_path / name), 3)
        return read(spark, tmp_path / name)

    def whole(repo, languages, names, counts, roots, points):
        scope = "\n".join(f"- {line}" for line in fv.SUMMARY_SCOPE)
        return (f"{fv.SUMMARY_TITLE}\n\n{fv.SUMMARY_INTRO}\n\n## Repository\n\n- Path: `/data/{repo}`\n- Languages: {languages}\n"
                f"- Frameworks: {names}\n- Instances: {counts[0]}\n- Root causes: {counts[1]}\n\n## Scope\n\n{scope}\n\n"
                f"## Candidate root causes\n\n{roots}\n## Review points\n\n{points}\n{fv.SUMMARY_RETAINED}\n\n## Limitations\n\n"
                f"{fv.SUMMARY_LIMITS}\n\n")

    zero = "- `RC-0` — T (secure_coding_concern; 1 related instances)\n  - Review locations: `a.py:10`\n"
    one = "- `RC-1` — T (secure_coding_concern; 2 related instances)\n"
    points = "- `id-c.py:1` — T — `c.py:1`\n"
    got = text(10, "few")
    assert got["r"] == whole("r", "go, python", "Django, Flask", (4, 3), f"{zero}{one}  - Review locations: `a.py:10`, `b.py:2`\n", points)
    assert got["e"] == whole("e", "java", "", (0, 0), "", "")
    # beyond the bound each location has its line, in the same order
    assert text(1, "many")["r"] == whole("r", "go, python", "Django, Flask", (4, 3),
                                         f"{zero}{one}  - Review locations: `a.py:10`\n  - Review locations: `b.py:2`\n", points)


def test_sarif_logs_are_valid_documents(spark, tmp_path):
    rows = [finding("a", f"f{n % 7}.py:{n}", title='q"\n') for n in range(1, 40)] + [finding(None, "x.py:1", "review_point")]
    found = table(spark, rows)
    repos = spark.createDataFrame([("a",), ("none",)], "repo string")
    documents.write_documents(documents.sarif_pieces(found, "t", "2", repos), str(tmp_path / "s"), 4)
    logs = {repo: json.loads(text) for repo, text in read(spark, tmp_path / "s").items()}
    assert {repo: len(log["runs"][0]["results"]) for repo, log in logs.items()} == {"a": 39, "": 1, "none": 0}
    assert logs["a"]["version"] == fv.SARIF_VERSION and logs["a"]["runs"][0]["tool"] == {"driver": {"name": "t", "version": "2"}}
    first = logs["a"]["runs"][0]["results"][0]
    assert first["ruleId"] == "R.1" and first["level"] == "error" and first["message"] == {"text": 'q"\n: D'}
    assert first["locations"][0]["physicalLocation"]["region"]["startLine"] == 7
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"])
              for r in logs["a"]["runs"][0]["results"]]
    assert places == sorted(places)


def test_order_holds_over_many_ranges(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.concat(F.lit("r"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("repo"), F.lit(1).alias("part"),
        F.lit(0).alias("descending"), F.format_string("%08d", F.xxhash64("id") % 10**7 + 10**7).alias("place"), F.lit(0).alias("line"),
        F.lit(None).cast(documents.EMIT_SEQ).alias("emit_seq")).withColumn("value", F.col("place"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_documents(rows.repartition(16), str(tmp_path / "o"), 300)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = read(spark, tmp_path / "o")
    assert sum(text.count("\n") for text in got.values()) == 20_000 and len(got) == 50
    for text in got.values():
        values = text.splitlines()
        assert values == sorted(values)


def test_written_scan_has_documents(spark, source, tmp_path):
    files = source(("one", "a.py", 'password = "hunter2hunter2"\n'), ("two", "b.py", "x = 1\n"))
    reports.write_scan(str(tmp_path / "out"), scan_files(files), files=files)
    for name in ("report", "summary", "sarif"):
        assert set(read(spark, tmp_path / "out" / name)) == {"one", "two"}
    assert "hunter2hunter2" not in read(spark, tmp_path / "out/report")["one"]


def test_frames_meet_their_pieces_and_lines_come_in_blocks(spark, tmp_path, monkeypatch):
    rows = [finding("r", f"f{n % 40:02}.py:{n}", confidence=50 + n % 3, evidence=f"line {n}\n  next", title=f"T{n % 5}", root_cause_id=f"RC-{n % 5}")
            for n in range(1, 1200)]
    # the same value in another column is another frame
    rows += [finding("r", "x.py:1", source="v", sink=None), finding("r", "x.py:2", source=None, sink="v")]
    found = table(spark, rows).repartition(5)
    roots = correlate.root_causes(found)

    def written(name, **more):
        documents.write_documents(documents.report_pieces(found, roots), str(tmp_path / name), 400, **more)
        return read(spark, tmp_path / name)

    plain = written("plain")
    blocks = sorted(reports.report_blocks(found).collect(), key=lambda r: (-r.confidence_score, r.file_path, r.start_line))
    leads = plain["r"].split("## Candidate review leads\n\n")[1].split("## Review points\n")[0]
    assert leads == "".join(r.block + "\n" for r in blocks)
    assert "`v` → `unknown`" in leads and "`unknown` → `v`" in leads
    assert written("gzip", compression="gzip") == plain
    assert {f.name[-3:] for f in (tmp_path / "gzip/repo=r").glob("part-*")} == {".gz"}
    assert sum(r.bytes for r in documents.offsets(spark, str(tmp_path / "gzip")).collect()) < len(plain["r"]) / 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        for name in ("plain", "gzip"):
            got = documents.read_documents(spark, str(tmp_path / name))
            assert max(r.lines for r in got.select("lines").collect()) <= 1000 < got.count() * 1000 / 4
            lines = documents.numbered_lines(got).orderBy("line_no").collect()
            assert [r.line for r in lines] == plain["r"][:-1].split("\n") and [r.line_no for r in lines] == list(range(1, len(lines) + 1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # frames that are many or long travel with their pieces
    monkeypatch.setattr(documents, "MOST_FRAMES", 3)
    assert written("many") == plain
    monkeypatch.undo()
    monkeypatch.setattr(documents, "MOST_FRAME_BYTES", 100)
    assert written("long") == plain


def test_sarif_results_do_not_meet_by_repository(spark, tmp_path, monkeypatch):
    rows = [finding("a", f"f{n % 9}.py:{n}", data_flow=[None, "x"] if n % 2 else ["x", None], title=f"T{n % 3}") for n in range(1, 300)]
    found = table(spark, [*rows, finding("b", 'q".py:1')]).repartition(4)

    def written(name):
        documents.write_documents(documents.sarif_pieces(found, "t", "2"), str(tmp_path / name), compression="gzip")
        return read(spark, tmp_path / name)

    plain = written("plain")
    records = {repo: [r.value for r in reports.sarif_records(found).filter(F.col("repo") == repo).orderBy("emit_seq").collect()] for repo in plain}
    log = {repo: json.loads(text) for repo, text in plain.items()}
    assert {repo: len(x["runs"][0]["results"]) for repo, x in log.items()} == {"a": 299, "b": 1}
    for repo, text in plain.items():
        assert text.split("\n")[1:-2] == ["," * (i > 0) + value for i, value in enumerate(records[repo])]
    # nothing but the first result of each repository is dealt out by its name
    plan = documents.sarif_pieces(found, "t", "2")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    # very many repositories meet by their names
    monkeypatch.setattr(reports, "MOST_REPOS", 1)
    assert written("many") == plain
