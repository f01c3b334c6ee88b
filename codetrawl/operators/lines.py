"""From files to lines: splitting, masking, and the candidate lines of a scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths
from ..functions import text as tx
from ..options import ScanOptions
from . import rules as rule_ops
from .rules import Rule

KEEP = ["repo", "path", "language", "code_surface"]
# texts that are searched in one go; one text alone may be larger
SEARCH_BYTES = 1 << 20
# what LINE_BREAK of functions.text takes for a line break besides a line feed, in UTF-8
_OTHER_BREAKS = [c.encode() for c in "\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"]
_ANY_BREAK = re.compile(b"\r\n|" + b"|".join(_OTHER_BREAKS))
# the letters beyond ASCII whose lower case has ASCII in it
_LOWER = {"\u212a".encode(): b"k", "\u0130".encode(): "i\u0307".encode()}


@dataclass(frozen=True)
class WordsOf:
    """What tasks need of a rule; its tests stay with the driver."""

    words: tuple[tuple[str, ...], ...]


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line: path, line_no, raw, uncommented, code."""
    language = F.col("language")
    tokens = files.withColumn("text", tx.normal_breaks(F.col("text"))).withColumn(
        "tokens", tx.tokens(F.col("text"), language)
    )
    arrays = tokens.select(
        "repo", "path", "language",
        tx.split_lines(F.col("text")).alias("raw"),
        tx.split_lines(tx.without_comments(F.col("tokens"), language), F.col("text")).alias("uncommented"),
        tx.split_lines(tx.code_only(F.col("tokens"), language), F.col("text")).alias("code"),
    )
    return _explode(arrays, ["repo", "path", "language"], ["raw", "uncommented", "code"])


def raw_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of a text column: the other columns, line_no, raw."""
    keep = [c for c in df.columns if c != text]
    lines = df.select(*keep, tx.split_lines(tx.normal_breaks(F.col(text))).alias("_lines"))
    exploded = lines.select(*keep, F.posexplode(tx.computed("_lines")).alias("_pos", "raw"))
    return exploded.select(*keep, (F.col("_pos") + 1).alias("line_no"), "raw")


def _explode(df: DataFrame, keep: list[str], arrays: list[str]) -> DataFrame:
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("_pos", "_line"))
    return rows.select(
        *keep, (F.col("_pos") + 1).alias("line_no"), *[F.col("_line")[name].alias(name) for name in arrays]
    )


def _either(words: Iterable[str]) -> str:
    return "|".join(re.sub(r"([.+*?^$|(){}\[\]\\])", r"\\\1", word) for word in words)


def _found(lines: pa.Array, words: Iterable[str]) -> np.ndarray:
    return pc.match_substring_regex(lines, _either(words)).to_numpy(zero_copy_only=False)


def _with_words(lines: pa.Array, rules: list[WordsOf]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines that hold the words of some rule, and these rules as bits."""
    places = np.arange(len(lines))
    if all(rule.words for rule in rules):
        places = np.flatnonzero(_found(lines, sorted({word for rule in rules for word in rule.words[0]})))
        lines = lines.take(pa.array(places))
    masks = np.zeros(len(lines), dtype=np.int64)
    tested: dict[tuple[str, ...], np.ndarray] = {}
    for bit, rule in enumerate(rules):
        found = np.ones(len(lines), dtype=bool)
        for words in rule.words:
            if words not in tested:
                tested[words] = _found(lines, words)
            found = found & tested[words]
        masks |= found.astype(np.int64) << bit
    kept = np.flatnonzero(masks)
    return places[kept], masks[kept]


def _has_other_breaks(text: bytes) -> bool:
    return any(sign in text for sign in _OTHER_BREAKS)


def _plain(text: bytes, other_breaks: bool) -> bytes:
    """The text with line feeds as its only breaks and in lower case as far as ASCII words can tell."""
    text = (_ANY_BREAK.sub(b"\n", text) if other_breaks else text).lower()
    for letter, lower in _LOWER.items():
        if letter in text:
            text = text.replace(letter, lower)
    return text


def _in_lines(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of some texts, line ends included, the text that each is of and the first line of each text."""
    data = b"".join(text if text.endswith(b"\n") else text + b"\n" for text in texts)
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
    counts = [text.count(b"\n") + (not text.endswith(b"\n")) for text in texts]
    return lines, np.repeat(np.arange(len(texts)), counts), np.cumsum([0, *counts])[:-1]


def _worded_rows(texts: list[bytes], rules: list[WordsOf], snippet_lines: int) -> tuple[np.ndarray, ...]:
    """(text, line_no, words, secrets) of the lines with words, text by text."""
    lines, owner, first = _in_lines(texts)
    places, masks = _with_words(lines, rules)
    shown = places[:, None] + np.arange(snippet_lines)
    inside = shown < len(lines)
    shown = np.minimum(shown, len(lines) - 1)
    inside &= owner[shown] == owner[places][:, None]
    needed = np.unique(shown)
    evidence, signs = lines.take(pa.array(needed)), np.zeros(len(lines), dtype=np.int32)
    for bit, words in enumerate(fv.SECRET_SIGNS):
        signs[needed] |= _found(evidence, words).astype(np.int32) << bit
    secrets = np.bitwise_or.reduce(np.where(inside, signs[shown], 0), axis=1, initial=0)
    return owner[places], (places - first[owner[places]] + 1).astype(np.int32), masks, secrets.astype(np.int32)


def _worded(texts: pa.Array, languages: pa.Array, groups: dict[str, list[WordsOf]], snippet_lines: int) -> pa.Array:
    """The lines with words of each text and whether it has other line breaks, see searched; a null or empty text has no lines."""
    texts, names = texts.cast(pa.binary()), languages.to_pylist()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    parts = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int32, np.int64, np.int32))]
    waiting: dict[int, list[int]] = {}
    held: dict[int, int] = {}
    other_breaks = np.zeros(len(texts), dtype=bool)

    def search(rows: list[int]) -> None:
        own = [texts[row].as_py() for row in rows]
        other_breaks[rows] = [_has_other_breaks(text) for text in own]
        found, *rest = _worded_rows([_plain(text, other_breaks[row]) for text, row in zip(own, rows)], groups[names[rows[0]]], snippet_lines)
        parts.append((np.array(rows, dtype=np.int64)[found], *rest))

    for row, (name, size) in enumerate(zip(names, sizes)):
        if size and name in groups:
            group = id(groups[name])
            waiting.setdefault(group, []).append(row)
            held[group] = held.get(group, 0) + size
            if held[group] >= SEARCH_BYTES:
                search(waiting.pop(group))
                del held[group]
    for rows in waiting.values():
        search(rows)
    rows, *fields = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(rows, kind="stable")
    values = pa.StructArray.from_arrays([pa.array(x[order]) for x in fields], ["line_no", "words", "secrets"])
    ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)
    return pa.StructArray.from_arrays([lists, pa.array(other_breaks)], ["lines", "other_breaks"])


def searched(text: Column, language: Column, rules: list[Rule], snippet_lines: int) -> Column:
    """`lines`: the lines of a text that hold the words of some rule in lower case: line_no, these rules as bits of the rules of
    the language, and the kinds of secrets (bits, in the order of SECRET_SIGNS) that the snippet from that line on has a sign of;
    `other_breaks`: whether the text, if it was searched, has line breaks besides line feeds, which end lines as well.

    One automaton looks for all words at once; the searches by single words only see the lines it finds.
    """
    groups: dict[str, list[WordsOf]] = {}
    for group in rule_ops.GROUPS:
        own = [WordsOf(rule.words) for rule in rule_ops.in_group(rules, group)]
        groups |= dict.fromkeys(group, own) if own else {}

    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return _worded(texts, languages, groups, snippet_lines)

    return F.arrow_udf(run, "struct<lines:array<struct<line_no:int,words:bigint,secrets:int>>,other_breaks:boolean>")(text, language)


def worded_lines(text: Column, language: Column, rules: list[Rule], snippet_lines: int) -> Column:
    """The lines of `searched` alone."""
    return searched(text, language, rules, snippet_lines)["lines"]


def candidate_lines(files: DataFrame, rules: list[Rule], options: ScanOptions) -> DataFrame:
    """Lines some rule of the list wants to look at, with contexts, evidence and rule bits.

    Work goes from cheap to dear. Lines with the words of a rule come from one search for all words, which also tells the few
    texts whose line breaks are to be replaced; only files with a line
    for a rule that reads masked text are tokenised; contexts and evidence are cut for lines that passed a gate. Lines
    are tested inside the row of their file, so what is exploded are the surviving lines, never a line together with its file.
    """
    path, text, language = F.col("path"), F.col("text"), F.col("language")
    no_lines = F.array().cast("array<string>")
    quotes = options.quotes
    found = files.select("repo", "path", "language", "code_surface", "text", searched(text, language, rules, max(1, quotes.lines)).alias("found"))
    worded = found.select("repo", "path", "language", "code_surface", F.col("found.lines").alias("worded"),
                          F.when(F.col("found.other_breaks"), tx.normal_breaks(text)).otherwise(text).alias("text"))
    bits = F.aggregate("worded", F.lit(0).cast("bigint"), lambda all_bits, line: all_bits.bitwiseOR(line["words"]))
    tokens = worded.withColumn("file_mask", bits).withColumn(
        "tokens", F.when(rule_ops.uses_code(rules, "file_mask"), tx.tokens(text, language)))
    masked = F.col("tokens").isNotNull()
    java = masked & (language == "java")  # no other rules read uncommented text
    arrays = tokens.select(
        "repo", "path", "language", "code_surface", "worded",
        paths.surface_of(path).alias("path_surface"),
        F.when(F.size("worded") > 0, tx.split_lines(text)).otherwise(no_lines).alias("raw_lines"),
        F.when(java, tx.split_lines(tx.without_comments(F.col("tokens"), language), text)).otherwise(no_lines)
        .alias("uncommented_lines"),
        F.when(masked, tx.split_lines(tx.code_only(F.col("tokens"), language), text)).otherwise(no_lines)
        .alias("code_lines"),
    )
    entries = """transform(worded, w -> named_struct('line_no', w.line_no, 'words', w.words, 'secrets', w.secrets,
        'raw_lines', get(raw_lines, w.line_no - 1), 'uncommented_lines', get(uncommented_lines, w.line_no - 1),
        'code_lines', get(code_lines, w.line_no - 1)))"""
    masks = rule_ops.line_masks(rules, entries, ("line_no", "secrets"))
    hits = F.filter(masks, lambda hit: hit["mask"] != 0)

    def with_contexts(hit: Column) -> Column:
        number = hit["line_no"]
        columns = [
            hit["mask"].alias("mask"), number.alias("line_no"),
            F.get("raw_lines", number - 1).alias("raw"),
            F.get("uncommented_lines", number - 1).alias("uncommented"),
            F.get("code_lines", number - 1).alias("code"),
            hit["secrets"].alias("secrets"),
            tx.snippet(F.col("raw_lines"), number, quotes.lines, quotes.lines > 0, hide=False).alias("snippet"),
        ]
        if any("contexts" in rule.uses for rule in rules):
            contexts = {
                "code_context": tx.context(F.col("code_lines"), number),
                "raw_context": tx.context(F.col("raw_lines"), number),
                "upload_context": tx.upload_context(F.col("uncommented_lines"), number),
            }
            columns += [F.when(rule_ops.reads(rules, hit["mask"], name), value).alias(name) for name, value in contexts.items()]
        return F.struct(*columns)

    keep = [*KEEP, "path_surface"]
    found = arrays.select(*keep, F.inline(F.transform(hits, with_contexts)))
    # a column of its own, which goes where nobody reads it
    shown = quotes.lines > 0 and quotes.hide_secrets
    evidence = tx.redacted_snippet(F.col("snippet"), F.col("secrets")) if shown else F.col("snippet")
    return found.withColumn("evidence", evidence).drop("snippet", "secrets")
