"""Whole documents, one for each repository: the report, the summary and the SARIF log as text files.

A document is a table of pieces (repo, part, descending, place, line, emit_seq, value). ``write_documents`` range-partitions the
pieces of all repositories by that order and writes every range at once, so that a document is a run of files of bounded size
whose names are in its order, and a large repository is written by many tasks. ``offsets`` says where each file of a document
begins. Nothing is gathered by repository.

A piece may have a frame, texts that many pieces share, for its own texts to stand in (``reports.woven``): ``first``, or if that is null
its place and line, and ``value``. Frames that are few are not moved with every piece: they meet the pieces in their range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import compare
from ..schema import EMIT_SEQ
from . import reports

ORDER = ["repo", "part", "descending", "place", "line", "emit_seq"]
FRAME = {"frame": "array<string>", "f1": "long", "f2": "long"}
ROWS_A_FILE = 50_000
# frames up to this number and size are sent to every task
MOST_FRAMES, MOST_FRAME_BYTES = 5_000, 4_096
# document files up to this number are numbered by a table that is sent to every task
MOST_FILES = 100_000
# a root cause with more review locations than this has one line for each
PLACES_A_LINE = 1_000


def _piece(rows: DataFrame, part, value: Column, descending=0, place="", line=0, seq=None, first=None) -> DataFrame:
    def column(given) -> Column:
        return given if isinstance(given, Column) else F.lit(given)

    return rows.select(
        "repo", column(part).cast("int").alias("part"), column(descending).cast("int").alias("descending"), column(place).alias("place"),
        column(line).cast("int").alias("line"), column(seq).cast(EMIT_SEQ).alias("emit_seq"), value.alias("value"),
        column(first).cast("string").alias("first"),
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FRAME.items()])


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def _named(rows: DataFrame) -> DataFrame:
    """Rows without a repository belong to that with the empty name."""
    return rows.withColumn("repo", F.coalesce("repo", F.lit("")))


def repository_counts(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(repo, root_causes, instances, review_leads, review_points); zeros for those of ``repos`` that have no finding.

    Findings are folded to a row for each root cause before repositories meet, so the size of a repository does not matter.
    """
    verdict = F.col("verdict_candidate")
    per_root = findings.groupBy("repo", "root_cause_id").agg(
        F.count("*").alias("instances"),
        F.count_if(~verdict.isin(*fv.REVIEW_VERDICTS, "suppressed")).alias("review_leads"),
        F.count_if(verdict.isin(*fv.REVIEW_VERDICTS)).alias("review_points"))
    names = ["root_causes", "instances", "review_leads", "review_points"]
    counted = per_root.withColumn("root_causes", F.lit(1).cast("long")).select("repo", *names)
    if repos is not None:
        zeros = repos.select("repo").distinct().select("repo", *[F.lit(0).cast("long").alias(n) for n in names])
        counted = counted.unionByName(zeros)
    return counted.groupBy("repo").agg(*[F.sum(n).alias(n) for n in names])


def report_pieces(findings: DataFrame, root_causes: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """The report of every repository: header, candidate leads, review points, root causes.

    Repositories without findings have a report if they are in ``repos``.
    """
    findings, root_causes = _named(findings), _named(root_causes)
    counts = repository_counts(findings, None if repos is None else _named(repos))
    labels = [F.concat(F.lit(f"{label}: "), F.col(name)) for label, name in zip(fv.REPORT_COUNTS, counts.columns[1:], strict=True)]
    header = F.concat(F.lit(f"{fv.REPORT_TITLE}\n\n{fv.REPORT_INTRO}\n\n"), F.concat_ws(" | ", *labels), F.lit("\n"))
    blocks = reports.report_parts(findings)
    parts = [_piece(counts, 0, header)]
    for number in (0, 1):
        parts.append(_piece(counts, 1 + 2 * number, F.lit(f"## {fv.REPORT_SECTIONS[number]}\n")))
        parts.append(_piece(blocks.filter(F.col("section_no") == number), 2 + 2 * number, F.col("shown"),
                            -F.col("confidence_score"), F.col("file_path"), F.col("start_line"), F.col("emit_seq")))
    # the empty line stands before a root cause, so that none follows the last
    parts.append(_piece(counts, 5, F.lit(f"## {fv.REPORT_SECTIONS[2]}")))
    root = F.concat(F.lit("\n- `"), F.col("root_cause_id"), F.lit("`: "), F.col("title"), F.lit(" ("),
                    F.col("instance_count"), F.lit(" instances)"))
    parts.append(_piece(root_causes, 6, root, place=F.col("root_cause_id")))
    return _union(parts)


def _location_lines(root_causes: DataFrame, findings: DataFrame, places_a_line: int) -> DataFrame:
    """(repo, root_cause_id, location, value): one line for a root cause's locations, or one each where they are many."""
    tick = F.concat(F.lit("`"), F.col("location"), F.lit("`"))
    places = compare.summary_locations(root_causes, findings)
    sizes = places.groupBy("repo", "root_cause_id").agg(F.count("*").alias("_size"))
    many = sizes.filter(F.col("_size") > places_a_line).select("repo", "root_cause_id")
    few = places.join(many, ["repo", "root_cause_id"], "left_anti").groupBy("repo", "root_cause_id").agg(
        F.sort_array(F.collect_list("location")).alias("_all"))
    ticked = F.transform("_all", lambda p: F.concat(F.lit("`"), p, F.lit("`")))
    one = few.select("repo", "root_cause_id", F.get("_all", F.lit(0)).alias("location"),
                     F.concat(F.lit(fv.SUMMARY_LOCATIONS), F.array_join(ticked, ", ")).alias("value"))
    each = places.join(many, ["repo", "root_cause_id"], "left_semi").select(
        "repo", "root_cause_id", "location", F.concat(F.lit(fv.SUMMARY_LOCATIONS), tick).alias("value"))
    return one.unionByName(each)


def summary_pieces(findings: DataFrame, root_causes: DataFrame, files: DataFrame, frameworks: DataFrame,
                   target: str = "", places_a_line: int = PLACES_A_LINE) -> DataFrame:
    """The summary of every repository in ``files``: its facts, the scope, candidate root causes, review points, limits.

    ``files`` has (repo, language), ``frameworks`` (repo, framework). Both lists are of names from fixed tables. The path is
    ``target`` with the repository's name below it.
    """
    findings, root_causes, files, frameworks = map(_named, (findings, root_causes, files, frameworks))

    def names(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy("repo").agg(F.array_join(F.sort_array(F.collect_set(column)), ", ").alias(name))

    facts = (repository_counts(findings, files).join(names(files, "language", "languages"), "repo", "left")
             .join(names(frameworks, "framework", "frameworks"), "repo", "left"))
    path = F.concat_ws("/", F.lit(target.rstrip("/")), "repo") if target else F.col("repo")
    texts = [F.concat(F.lit("`"), path, F.lit("`")), F.coalesce("languages", F.lit("")), F.coalesce("frameworks", F.lit("")),
             F.col("instances").cast("string"), F.col("root_causes").cast("string")]
    lines = [F.concat(F.lit(f"- {label}: "), text) for label, text in zip(fv.SUMMARY_FACTS, texts, strict=True)]
    top = "\n".join([fv.SUMMARY_TITLE, "", fv.SUMMARY_INTRO, "", "## Repository", "", ""])
    scope = "\n".join(["", "", "## Scope", "", *[f"- {line}" for line in fv.SUMMARY_SCOPE], "", "## Candidate root causes", ""])
    end = "\n".join(["", fv.SUMMARY_RETAINED, "", "## Limitations", "", fv.SUMMARY_LIMITS, ""])
    head = F.concat(F.lit(top), F.concat_ws("\n", *lines), F.lit(scope))
    shown = root_causes.filter(~F.col("root_cause_type").isin(*fv.REVIEW_VERDICTS))
    title = F.concat(F.lit("- `"), F.col("root_cause_id"), F.lit("` — "), F.col("title"), F.lit(" ("), F.col("root_cause_type"),
                     F.lit("; "), F.col("instance_count"), F.lit(" related instances)"))
    places = _location_lines(root_causes, findings, places_a_line)
    # of a root cause first its title (line 0), then its locations in order
    return _union([
        _piece(facts, 0, head),
        _piece(shown, 1, title, place=F.concat("root_cause_id", F.lit("\n"))),
        _piece(places, 1, F.col("value"), place=F.concat_ws("\n", "root_cause_id", "location"), line=1),
        _piece(facts, 2, F.lit("\n## Review points\n")),
        _piece(reports.summary_review_points(findings), 3, F.col("value"), seq=F.col("emit_seq")),
        _piece(facts, 4, F.lit(end)),
    ])


def sarif_pieces(findings: DataFrame, tool: str, version: str, repos: DataFrame | None = None) -> DataFrame:
    """The SARIF log of every repository, one result a line; an empty list of results for those without findings."""
    findings = _named(findings)
    log = reports.sarif_parts(findings, tool, version)
    pieces = _piece(log, F.col("part"), F.col("value"), seq=F.col("emit_seq"), first=F.col("first"))
    if repos is None:
        return pieces
    bare = _named(repos).select("repo").distinct().join(findings.select("repo").distinct(), "repo", "left_anti")
    return _union([pieces, _piece(bare, 0, F.concat(reports.sarif_head(tool, version), F.lit(reports.SARIF_END)))])


def _few_frames(pieces: DataFrame) -> DataFrame | None:
    """(f1, f2, texts): the frames of ``pieces``, if they are few and short enough to be sent to every task."""
    framed = pieces.filter(F.col("f1").isNotNull())
    if framed.agg(F.approx_count_distinct("f1")).first()[0] > MOST_FRAMES:
        return None
    short = F.when(F.octet_length(F.array_join("frame", "")) <= MOST_FRAME_BYTES, F.col("frame"))
    found = framed.select("f1", "f2", short.alias("texts")).distinct().limit(MOST_FRAMES + 1).collect()
    if len(found) > MOST_FRAMES or any(row.texts is None for row in found):
        return None
    return pieces.sparkSession.createDataFrame(found, "f1 long, f2 long, texts array<string>")


def _whole(frame: str) -> Column:
    """The text of a piece: its value, or its own texts in their frame."""
    first = F.coalesce("first", F.concat_ws(":", "place", F.col("line").cast("string")))
    return F.when(F.col(frame).isNull(), F.col("value")).otherwise(reports.woven(frame, first, F.col("value"))).alias("value")


def _dealt(pieces: DataFrame) -> DataFrame:
    """(*ORDER, value), dealt out by ranges of ORDER."""
    if "frame" not in pieces.columns:
        return pieces.repartitionByRange(*ORDER)
    few = _few_frames(pieces)
    if few is None:
        return pieces.select(*ORDER, _whole("frame")).repartitionByRange(*ORDER)
    moved = pieces.drop("frame").repartitionByRange(*ORDER)
    return moved.join(F.broadcast(few), ["f1", "f2"], "left").select(*ORDER, _whole("texts"))


def write_documents(pieces: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE, compression: str = "none") -> None:
    """Write documents as ``path/repo=<name>/part-<n>...txt``; a document is its files in the order of their names.

    A piece is followed by one line end. All repositories are written in one job, each range of the order by one task.
    ``compression`` may be gzip: files that lie one behind the other are a gzip file of the whole document.
    """
    # a name that is never null needs no rewriting before it becomes a folder, which keeps the order below it
    ordered = _dealt(_named(pieces)).sortWithinPartitions(*ORDER)
    (ordered.select("repo", "value").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
     .option("compression", compression).partitionBy("repo").text(path))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (k1, k2, at, line) in their order as one text for each batch and split of a file."""
    held, before = None, 0
    for batch in batches:
        keys, line = batch.columns[:3], batch.column(3)
        if not len(line):
            continue
        new = np.zeros(len(line), dtype=bool)
        for values in map(np.asarray, keys):
            new[1:] |= values[1:] != values[:-1]
        places = np.frombuffer(line.buffers()[1], dtype=np.int32)[line.offset:]
        firsts = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(firsts, [*firsts[1:], len(line)], strict=True):
            split = tuple(column[i].as_py() for column in keys)
            if split != held:
                held, before = split, 0
            first, end = int(places[i]), int(places[j])
            # the lines lie one behind the other already
            text = [None, pa.py_buffer(np.array([0, end - first], dtype=np.int32)), line.buffers()[2].slice(first, end - first)]
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*split, before, j - i)], pa.Array.from_buffers(pa.string(), 1, text)],
                                             names=["k1", "k2", "at", "before", "lines", "text"])
            before += j - i


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(repo, file, before, lines, text): the files of written documents in blocks of whole lines.

    ``before`` is the number of the document's lines that stand before the block, ``lines`` that of the block itself, which
    are at most the rows of an Arrow batch. Line counts of files are all that meets by repository.
    """
    rows = spark.read.schema("value string, repo string").text(path, lineSep="\n").select(
        F.coalesce("repo", F.lit("")).alias("repo"), F.col("_metadata.file_name").alias("file"), "value",
        F.xxhash64("_metadata.file_path").alias("k1"), F.xxhash64(F.lit(1), "_metadata.file_path").alias("k2"),
        F.col("_metadata.file_block_start").alias("at"))
    # a large file that is not compressed may have several splits
    split = ["k1", "k2", "at"]
    counts = rows.groupBy("repo", "file", *split).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("repo").orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("repo", "file", *split, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    if len(rows.inputFiles()) <= MOST_FILES:  # the texts stay where they are read
        starts = F.broadcast(starts)
    blocks = rows.select(*split, F.concat("value", F.lit("\n")).alias("line")).mapInArrow(
        _blocks, "k1 long, k2 long, at long, before long, lines long, text string")
    known = F.coalesce("start", F.raise_error(F.lit("a document was split differently when its lines were counted")).cast("long"))
    return blocks.join(starts, split, "left").select("repo", "file", (known + F.col("before")).alias("before"), "lines", "text")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(repo, file, first_byte, bytes): where each file of a document lies in it, from the listing alone.

    Of compressed documents the bytes are those of the compressed files.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary, repo string"
    listed = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt{,.gz}").load(path)
    files = listed.select(F.coalesce("repo", F.lit("")).alias("repo"),
                          F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    before = Window.partitionBy("repo").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("repo", "file", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"), "bytes")


def numbered_lines(documents: DataFrame) -> DataFrame:
    """(repo, line_no, line) of documents as ``read_documents`` gives them."""
    lines = documents.select("repo", "before", "lines", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # behind the last line end there is no line
    return lines.filter(F.col("pos") < F.col("lines")).select("repo", (F.col("before") + F.col("pos") + 1).alias("line_no"), "line")
