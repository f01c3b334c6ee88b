"""Line dedup by site-relative frequency (DataFrame functions only).

A line is boilerplate of its site if the pages that contain it are more than `ratio` of the site's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stored

BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    """64 bits of the line without blanks around it; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3,
                copies_once: bool = False) -> DataFrame:
    """(host, keys): the lines of a site that exceed the ratio.

    With `copies_once` pages of a site with equal texts (64 bits) count as one page, in the lines and in the total.

    A site has fewer than (mean distinct lines of its pages) / ratio such lines, so `keys` does not grow with the site.
    Lines are counted once a page, by map-side sums; no task ever holds a whole site.
    """
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    if copies_once:
        pages = pages.withColumn("page", F.xxhash64("text"))
    counted = F.count_distinct("page") if copies_once else F.count("*")
    totals = pages.groupBy("host").agg(counted.alias("pages"))
    lines = pages.select("host", *pages.columns[2:], F.explode(F.array_distinct(F.transform(F.split("text", "\n"), line_key))).alias("key"))
    often = (lines.where("key is not null").groupBy("host", "key").agg(counted.alias("found"))
             .where(F.col("found") >= min_pages))
    return (often.join(totals, "host").where(F.col("found") > F.lit(ratio) * F.col("pages"))
            .groupBy("host").agg(F.collect_list("key").alias("keys")))


def drop_site_lines(docs: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.05, min_pages: int = 3,
                    copies_once: bool = False) -> DataFrame:
    """`docs` without the boilerplate lines of their sites, with n_lines and n_dropped (columns of these names are replaced).

    Lines are cut at \\n and compared without blanks around them; blank lines are neither counted nor dropped; all
    occurrences of a boilerplate line go, other lines keep their bytes. Pages count once for every row, whatever their
    ids, or with `copies_once` once for every distinct text of a site, so that copies never make each other boilerplate; null and empty hosts are one site; a null text stays null and has no lines; an empty table stays empty.
    The small table of boilerplate is written first, so that Spark broadcasts it only if its real size allows that.
    """
    store = Stored(docs.sparkSession, "line_dedup")
    found = store.put(boilerplate(docs, text=text, host=host, ratio=ratio, min_pages=min_pages, copies_once=copies_once)).select(
        F.col("host").alias("_site"), F.col("keys").alias("_keys"))
    rows = docs.join(found, F.coalesce(docs[host].cast("string"), F.lit("")) == F.col("_site"), "left")
    # a blank line has a null key, of which array_contains says null
    keep = F.filter("_lines", lambda x: F.coalesce(~F.array_contains("_keys", line_key(x)), F.lit(True)))
    split = rows.withColumn("_lines", F.split(docs[text], "\n"))
    split = split.withColumn("_kept", F.when(F.col("_keys").isNull(), F.col("_lines")).otherwise(keep))
    own = {
        text: F.array_join("_kept", "\n"),
        "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long"),
    }
    # size() of null is -1 unless the session says otherwise
    own["n_lines"] = F.when(docs[text].isNull(), F.lit(0)).otherwise(own["n_lines"]).cast("long")
    own["n_dropped"] = F.when(docs[text].isNull(), F.lit(0)).otherwise(own["n_dropped"]).cast("long")
    return split.select(*[own[c].alias(c) if c in own else docs[c] for c in docs.columns],
                        *[own[c].alias(c) for c in ("n_lines", "n_dropped") if c not in docs.columns])
