"""What a repository is made of: frameworks, components, manifests, skipped entries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths
from ..functions import text as tx


def _marker_regex(marker: str) -> str:
    """The marker on its own, not inside a longer name; the same in every regex dialect."""
    return rf"(?i)(?:^|[^A-Za-z0-9_]){re.escape(marker)}(?:[^A-Za-z0-9_]|\z)"


def framework_flags(text: Column, lowered: Column) -> list[Column]:
    """One boolean per framework; a plain substring test keeps most regexes from running."""
    flags = []
    for name, markers in fv.FRAMEWORK_MARKERS.items():
        condition = F.lit(False)
        for marker in markers:
            condition = condition | (lowered.contains(marker) & text.rlike(_marker_regex(marker)))
        flags.append(condition.alias(name))
    return flags


def frameworks(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(repo, framework), from the text of source files and root manifests.

    ``manifests`` has (repo, path, text, size); only the known manifests at the root of a
    repository count, whatever their size. One boolean row per file, folded per repository before the
    shuffle, so what is exchanged does not depend on the size of the texts.
    """
    texts = files.select("repo", "text")
    if manifests is not None:
        root = F.col("path").isin(*fv.FRAMEWORK_MANIFESTS)
        texts = texts.unionByName(manifests.filter(root).select("repo", "text"))
    names = list(fv.FRAMEWORK_MARKERS)
    lowered = texts.withColumn("lowered", F.lower("text"))
    flags = lowered.select("repo", *framework_flags(F.col("text"), F.col("lowered")))
    seen = flags.groupBy("repo").agg(*[F.bool_or(F.col(f"`{n}`")).alias(f"f{i}") for i, n in enumerate(names)])
    found = F.explode(F.array(*[F.when(F.col(f"f{i}"), F.lit(n)) for i, n in enumerate(names)]))
    return seen.select("repo", found.alias("framework")).filter(F.col("framework").isNotNull())


def component_of(lowered: Column) -> Column:
    """Component category of a lower-cased file text, null when no keyword is in it."""
    cases = None
    for category, words in fv.COMPONENT_KEYWORDS:
        condition = tx.contains_any(lowered, words)
        cases = F.when(condition, F.lit(category)) if cases is None else cases.when(condition, F.lit(category))
    return cases


def components(files: DataFrame) -> DataFrame:
    """(repo, category, path): the one category of each file that has one.

    The text is lower-cased once: it is the only element of an array that the category test
    maps over, and files without a category vanish with their null.
    """
    category = F.filter(F.transform(F.array(F.lower("text")), component_of), lambda c: c.isNotNull())
    return files.select("repo", "path", F.explode(category).alias("category"))


def manifests(listing: DataFrame) -> DataFrame:
    """(repo, path) of the dependency, build and deployment manifests of a listing."""
    known = paths.base_name(F.col("path")).isin(*fv.MANIFEST_NAMES)
    return _regular(listing).filter(known).select("repo", "path")


def _regular(listing: DataFrame) -> DataFrame:
    """Without links and directories that were not entered."""
    if "is_symlink" in listing.columns:
        listing = listing.filter(~F.col("is_symlink"))
    return listing.filter(~F.col("error").eqNullSafe(fv.SKIP_EXCLUDED)) if "error" in listing.columns else listing


def lock_files(manifest_table: DataFrame) -> DataFrame:
    path = F.col("path")
    condition = path.contains(fv.LOCK_CONTAINS)
    for suffix in fv.LOCK_SUFFIXES:
        condition = condition | path.endswith(suffix)
    return manifest_table.filter(condition)


def build_files(manifest_table: DataFrame) -> DataFrame:
    condition = F.lit(False)
    for suffix in fv.BUILD_SUFFIXES:
        condition = condition | F.col("path").endswith(suffix)
    return manifest_table.filter(condition)


def deployment_files(listing: DataFrame) -> DataFrame:
    named = tx.contains_any(F.lower(paths.base_name(F.col("path"))), fv.DEPLOYMENT_NAME_PARTS)
    return _regular(listing).filter(named).select("repo", "path")


def inventory(files: DataFrame, listing: DataFrame, skipped: DataFrame, framework_table: DataFrame) -> DataFrame:
    """(repo, kind, value, count): the whole inventory as one long table."""
    def entries(df: DataFrame, kind, value: str = "path") -> DataFrame:
        label = F.lit(kind) if isinstance(kind, str) else kind
        return df.select("repo", label.alias("kind"), F.col(value).alias("value"), F.lit(1).cast("long").alias("count"))

    known = manifests(listing)
    languages = files.groupBy("repo", "language").agg(F.count("*").alias("count")).select(
        "repo", F.lit("languages").alias("kind"), F.col("language").alias("value"), "count")
    parts = [
        languages,
        entries(framework_table, "frameworks", "framework"),
        entries(known, "dependency_manifests"),
        entries(lock_files(known), "lock_files"),
        entries(build_files(known), "build_files"),
        entries(deployment_files(listing), "deployment_files"),
        entries(skipped, "skipped_files"),
        entries(components(files), F.col("category")),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
