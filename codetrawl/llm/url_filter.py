"""URL filters with redirect equivalence (DataFrame functions only).

A rule is (host, path, verdict) and fits a host with all its subdomains if the path of the url starts with the rule's
path. Pages that no rule fits get the decision of their aliases: urls are joined by redirects, canonical links in the
page and the usual implied redirects (scheme, `www.` and `m.`, trailing slash, fragment, tracking parameters); a group
of aliases is blocked if a rule blocks one of them, unless a rule explicitly allows one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stored, ascii_lower, connected_components

# fixed values: parameters that do not change the page
TRACKING = r"(^|&)(utm_[^&=]*|ref|gclid|fbclid)=[^&]*"
ALIAS_LABELS = r"^(www|m)\."
# fixed values: where a page names another url for itself
CANONICAL = r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*>"""
CANONICAL_HREF = r"""(?i)\bhref=["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b[^>]*http-equiv=["']?refresh["']?[^>]*\burl=["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    start = F.locate("://", url)
    return F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; null and urls without :// give the empty text."""
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """One text for all urls that differ by an implied redirect only; null for what is no url."""
    host = F.regexp_replace(host_of(url), ALIAS_LABELS, "")
    query = F.regexp_replace(F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    key = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host_of(url) != "", key)


def resolved(target: Column, url: Column) -> Column:
    """An absolute url from what a link says on the page `url`."""
    root = F.concat(F.lit("http://"), host_of(url))
    return (F.when(F.contains(target, F.lit("://")), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .otherwise(F.concat(root, F.regexp_replace(path_of(url), "[^/]*$", ""), target)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): canonical links and refresh redirects named in pages. One read; pages without either end first."""
    lower = F.lower(F.col(html))
    named = pages.where(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh")))
    found = named.select(F.col(url).alias("url"), F.explode(F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), CANONICAL_HREF, 1),
        F.regexp_extract(html, REFRESH, 1))).alias("target"))
    return found.where("target <> '' and url is not null").select("url", resolved(F.col("target"), F.col("url")).alias("target"))


def fitting_rules(pages: DataFrame, rules: list[tuple[str, str, str]], url: str, store: Stored) -> DataFrame:
    """(host, rules): for every host that occurs, the rules that fit it or a parent domain.

    Works on distinct hosts; the list of a host is bounded by the rules given for its parent domains.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string").distinct()
    hosts = pages.select(host_of(F.col(url)).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    parents = hosts.withColumn("rule_host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fit = (parents.join(table, "rule_host").groupBy("host")
           .agg(F.collect_list(F.struct(
               F.length(F.concat("rule_host", "rule_path")).alias("size"),
               F.concat("rule_host", "rule_path").alias("rule"),
               F.col("rule_path"), F.col("verdict"))).alias("rules")))
    return store.put(fit)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, *,
                 url: str = "url", html: str | None = "html", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict (columns of these names are replaced).

    `redirects` has (url, target). Null urls and texts without :// have empty host and path, no rule, no aliases and
    the default verdict; repeated rows stay repeated; an empty table gives an empty table. The longest fitting rule
    wins, of equal rules with different verdicts the greater text (block).
    """
    store = Stored(pages.sparkSession, "url_verdicts")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    links = page_links(pages, url, html) if html and html in pages.columns else None
    if redirects is not None:
        given = redirects.select("url", "target")
        links = given if links is None else links.union(given)
    # rules also decide about urls that are only linked to
    every = pages.select(F.col(url))
    if links is not None:
        links = store.put(links)
        every = every.union(links.select("url")).union(links.select("target"))
    fit = fitting_rules(every, rules, url, store).select(F.col("host").alias("_h"), F.col("rules").alias("_rules"))

    def judged(frame: DataFrame, columns: list[Column]) -> DataFrame:
        rows = frame.select(*columns, host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"),
                            alias_key(F.col(url)).alias("_key"))
        rows = rows.join(fit, F.col("_host") == F.col("_h"), "left").drop("_h")
        best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["rule_path"])))
        return rows.withColumn("_best", best).drop("_rules")

    said = (judged(every, []).where("_best is not null and _key is not null").groupBy(F.col("_key").alias("key"))
            .agg(F.max(F.col("_best.verdict") == "allow").alias("allowed"), F.max(F.col("_best.verdict") == "block").alias("blocked")))
    if links is None:
        groups = said.select("key", F.col("key").alias("component")).limit(0)
    else:
        edges = links.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"))
        groups = connected_components(edges, store).select(F.col("node").alias("key"), "component")
    members = said.join(groups, "key", "full").select("key", "allowed", "blocked", F.coalesce("component", "key").alias("component"))
    verdicts = (members.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
                .where("blocked and not coalesce(allowed, false)").select("component"))
    blocked = store.put(members.join(verdicts, "component", "left_semi").select(F.col("key").alias("_k")).distinct()
                        .withColumn("_blocked", F.lit(True)))
    out = judged(pages, [F.col(c) for c in kept]).join(blocked, F.col("_key") == F.col("_k"), "left")
    return out.select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.when(F.col("_blocked"), "block"), F.lit(default)).alias("verdict"))
