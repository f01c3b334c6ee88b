"""The scan: files in, findings out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths
from ..operators import authz, enrich, rules
from ..operators.correlate import with_root_cause
from ..operators.lines import KEEP, candidate_lines
from ..operators.rules import CustomRule
from ..options import ScanOptions
from ..schema import FINDINGS

AUTHZ_KEY = fv.AUTHZ_RULE[0]


def local_findings(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    custom_rules: Iterable[CustomRule] = (),
    only: Iterable[str] | None = None,
    framework: str | None = None,
    function_rules: bool = True,
) -> DataFrame:
    """Findings of the line rules and, for Python, the function rule, enriched and filtered.

    Every step up to here is narrow except the function rule: rows of a file stay in one
    row until the matching lines are known, and duplicates can only arise within one line,
    where the rules already give way to each other. ``only`` restricts the variants looked for.
    """
    spark = files.sparkSession
    custom = tuple(custom_rules)
    entries = rules.catalogue_entries(custom)
    keys = {entry["key"] for entry in entries}
    templates = rules.templates(spark, entries, options)
    if options != ScanOptions():
        # rules that could only yield filtered-out findings are not evaluated on any line;
        # the collected keys are those of the catalogue, never of the data
        keys = {row["match_key"] for row in templates.select("match_key").distinct().collect()}
    active = frozenset(keys if only is None else keys & set(only))
    files = enrich.language_filter(files, options.sources.languages)
    if options.sources.globs:
        files = files.filter(paths.matches_any_glob(F.col("path"), options.sources.globs))

    parts = []
    table = rules.broadcast_templates(templates, 4 * len(entries))
    for batch in rules.batches(rules.line_rules(active, custom)):
        languages = sorted({language for rule in batch for language in rule.languages})
        lines = candidate_lines(files.filter(F.col("language").isin(*languages)), batch, options)
        matches = rules.line_matches(lines, batch, active, [*KEEP, "path_surface"])
        parts.append(rules.to_findings(matches, table, framework))
    if function_rules and (only is None or AUTHZ_KEY in set(only)):
        functions = authz.functions_without_control(
            files, options.quotes.lines, options.quotes.lines > 0, options.quotes.hide_secrets)
        found = authz.to_findings(functions, framework)
        parts.append(found.transform(enrich.enrich).transform(enrich.apply_filters, options))
    if not parts:
        return spark.createDataFrame([], FINDINGS)
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    return findings


def scan_files(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    custom_rules: Iterable[CustomRule] = (),
    imported: DataFrame | None = None,
    frameworks: DataFrame | None = None,
) -> DataFrame:
    """The findings table of a scan, with root-cause ids.

    Imported results are not filtered. They can only repeat each other (their rule ids start
    with EXT), so the shuffle for duplicates is theirs alone, unless caller-supplied rules
    could meet other rules on a line.
    """
    custom = tuple(custom_rules)
    findings = local_findings(files, options, custom)
    if custom:
        findings = enrich.dedup(findings)
    if frameworks is not None:
        findings = enrich.with_framework(findings, enrich.framework_filter(frameworks, options.kept.frameworks))
    if imported is not None:
        findings = findings.unionByName(enrich.dedup(imported))
    return with_root_cause(findings)
