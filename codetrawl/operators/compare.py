"""Operators over the findings of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def _versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per finding id: instance counts and last classification of either run.

    Both runs go through one grouping by id instead of a full outer join; repeats of an id
    are folded map-side.
    """
    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select("repo", "id", "classification", "emit_seq", F.lit(side).alias("side"))

    both = tagged(old, 0).unionByName(tagged(new, 1))
    def latest(side: int):
        chosen = F.col("side") == side
        return F.max_by(F.when(chosen, F.col("classification")), F.when(chosen, F.col("emit_seq")))

    return both.groupBy("repo", "id").agg(
        F.count_if(F.col("side") == 0).alias("old_count"),
        F.count_if(F.col("side") == 1).alias("new_count"),
        latest(0).alias("old_classification"),
        latest(1).alias("new_classification"),
    )


def _count(versions: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return versions.agg(
        F.coalesce(F.sum("old_count"), zero).alias("old_instances"),
        F.coalesce(F.sum("new_count"), zero).alias("new_instances"),
        F.count_if(F.col("old_count") == 0).alias("added"),
        F.count_if(F.col("new_count") == 0).alias("removed"),
    )


def _changed(versions: DataFrame) -> DataFrame:
    both = (F.col("old_count") > 0) & (F.col("new_count") > 0)
    differs = ~F.col("old_classification").eqNullSafe(F.col("new_classification"))
    return versions.filter(both & differs).select("repo", "id", "old_classification", "new_classification")


def counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: instances of both runs, ids added and ids removed."""
    return _count(_versions(old, new))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids in both runs whose classification differs."""
    return _changed(_versions(old, new))


def _run_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same as ``_versions`` of runs written by ``sources.runs``: buckets meet as they lie, nothing is exchanged."""
    def folded(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("repo", "id").agg(
            F.count("*").alias(f"{side}_count"), F.max_by("classification", "emit_seq").alias(f"{side}_classification"))

    # merging buckets needs no copy of either side, however small one may seem
    both = folded(old, "old").hint("merge").join(folded(new, "new"), ["repo", "id"], "full_outer")
    return both.fillna(0, ["old_count", "new_count"])


def run_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """``counts`` of two written runs without an exchange below the one row of the result."""
    return _count(_run_versions(old, new))


def run_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``changes`` of two written runs without an exchange."""
    return _changed(_run_versions(old, new))


def unreported(files: DataFrame, findings: DataFrame, count: int = fv.SAMPLE_FILES) -> DataFrame:
    """The first ``count`` files in path order that look security-sensitive and have no finding.

    The keyword test runs in the scan of the files; the texts stay behind it and only
    paths meet the findings, of which each path travels once from a task. Every task keeps
    its first ``count`` paths, so no order is made of all files.
    """
    words = "|".join(fv.SAMPLE_KEYWORDS)
    sensitive = files.filter(F.lower("path").rlike(words) | F.lower("text").rlike(words)).select("repo", F.col("path").alias("file_path"))
    reported = findings.select("repo", "file_path").distinct()
    return (
        sensitive.join(reported, ["repo", "file_path"], "left_anti")
        .orderBy("file_path", "repo").limit(count)
        .withColumn("reason", F.lit(fv.SAMPLE_REASON))
    )


# A root cause may own any share of all findings. Those with more findings than this are dealt to several tasks, by count.
ROWS_A_SHARE = 1 << 20


def _with_roots(members: DataFrame, roots: DataFrame, by: str, rows_a_share: int) -> DataFrame:
    """Members of root causes with the columns of ``roots``, which have an ``instance_count``.

    A root cause of many findings is repeated for as many shares as its count asks for, and its members are dealt to them by
    the column ``by``; all others are joined as they are. What goes to all tasks is a row for each such root cause, and there
    are fewer than findings / ``rows_a_share`` of them.
    """
    shares = F.ceil(F.col("instance_count") / F.lit(rows_a_share)).cast("int")
    large = roots.filter(F.col("instance_count") > rows_a_share).select("repo", "root_cause_id", shares.alias("_shares"))
    dealt = (members.join(F.broadcast(large), ["repo", "root_cause_id"], "left")
             .withColumn("_share", F.pmod(F.xxhash64(by), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares"))
    repeated = roots.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.join(repeated, ["repo", "root_cause_id", "_share"]).drop("_share")


def handoff(root_causes: DataFrame, findings: DataFrame, rows_a_share: int = ROWS_A_SHARE) -> DataFrame:
    """(repo, root_cause_id, priority, finding_id, path, reason): context asked for per root cause.

    One row per context entry; a root cause may own any share of the findings, so its entries
    are not folded into one list.
    """
    high = F.col("root_cause_type").isin(*fv.HIGH_PRIORITY_TYPES)
    roots = root_causes.select(
        "repo", "root_cause_id",
        F.when(high, F.lit("high")).otherwise(F.lit("normal")).alias("priority"), "instance_count",
    )
    members = findings.select("repo", "root_cause_id", F.col("id").alias("finding_id"),
                              F.col("file_path").alias("path"), "emit_seq")
    return _with_roots(members, roots, "finding_id", rows_a_share).select(
        "repo", "root_cause_id", "priority", "finding_id", "path",
        F.lit(fv.HANDOFF_REASON).alias("reason"), "emit_seq",
    )


def handoff_flat(findings: DataFrame) -> DataFrame:
    """One request per finding, for results without root causes."""
    return findings.select(
        "repo", F.col("id").alias("finding_id"), "file_path",
        F.array("start_line", "end_line").alias("line_range"),
        F.concat("related_callers", "related_callees").alias("related_callers_or_callees"),
        F.col("related_routes").alias("related_security_components"),
        F.lit(fv.HANDOFF_FLAT_REASON).alias("reason"),
        "proof_gaps", "counterevidence",
        F.array(*[F.lit(x) for x in fv.HANDOFF_CONTEXT]).alias("minimum_context_required"),
        "emit_seq",
    )


def summary_locations(root_causes: DataFrame, findings: DataFrame, rows_a_share: int = ROWS_A_SHARE) -> DataFrame:
    """Distinct review locations of every root cause that is more than a review point.

    (repo, root_cause_id, title, root_cause_type, instance_count, location) rows; distinct
    locations of a root cause are not gathered into one cell.
    """
    roots = root_causes.filter(~F.col("root_cause_type").isin(*fv.REVIEW_VERDICTS)).select(
        "repo", "root_cause_id", "title", "root_cause_type", "instance_count")
    location = F.concat_ws(":", F.col("file_path"), F.col("start_line").cast("string"))
    places = findings.select("repo", "root_cause_id", location.alias("location")).distinct()
    return _with_roots(places, roots, "location", rows_a_share).select(*roots.columns, "location")
