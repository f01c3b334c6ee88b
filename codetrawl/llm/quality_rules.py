"""Quality rules as a short-circuit cascade.

Every document gets the base counts. Documents that pass the base test go through further rules one after the other
until one rejects them. The order comes from a sample: each rule's cost (seconds) and selectivity (share it rejects)
are measured there, and rules run by rejections per second, best first. The order decides how much work is done, never
which documents are kept.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

BLOCK_BYTES = 1 << 22
SAMPLE_ROWS = 2000
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))


class Page:
    """One text with counts that are worked out when a rule asks for them."""

    def __init__(self, data: bytes):
        self.data = data
        self.words = data.split()  # blanks are 0x20, 0x09 to 0x0D

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined.translate(None, bytes(range(0x80, 0xC0))))  # continuation bytes start no code point

    @cached_property
    def symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that equal an earlier line."""
        full = [x for x in self.data.split(b"\n") if x and not x.isspace()]
        return len(full), len(full) - len(set(full))

    @cached_property
    def ids(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), dtype=np.int64, count=len(self.words))

    @cached_property
    def repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more."""
        ids = self.ids
        if len(ids) < 4:
            return 0
        pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
        _, place, found = np.unique(pairs[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
        again = found[place] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[k:k + len(again)] |= again
        return int(covered.sum())

    @property
    def base_failed(self) -> bool:
        return len(self.words) < MIN_WORDS or 100 * self.repeat_words > 50 * len(self.words)


def _many_symbols(p: Page) -> bool:
    return 10 * p.symbols > len(p.words)


def _repeated_lines(p: Page) -> bool:
    return 10 * p.lines[1] > 7 * p.lines[0]


def _word_length(p: Page) -> bool:
    return not 2 * len(p.words) <= p.word_chars <= 15 * len(p.words)


def _few_letters(p: Page) -> bool:
    named = sum(1 for w in p.words if len(w.translate(None, _LETTERS)) < len(w) or any(map(str.isalpha, w.decode("utf-8", "replace"))))
    return 10 * named < 6 * len(p.words)


def _capitals(p: Page) -> bool:
    letters = len(p.data) - len(p.data.translate(None, _LETTERS))
    return 2 * (len(p.data) - len(p.data.translate(None, _LETTERS[:26]))) > letters


def _one_word(p: Page) -> bool:
    return bool(p.words) and 10 * Counter(p.words).most_common(1)[0][1] > 3 * len(p.words)


RULES: dict[str, Callable[[Page], bool]] = {
    "many_symbols": _many_symbols,
    "repeated_lines": _repeated_lines,
    "word_length": _word_length,
    "few_letters": _few_letters,
    "capitals": _capitals,
    "one_word": _one_word,
}


def measured_order(docs: DataFrame, text: str, rules: dict[str, Callable[[Page], bool]], sample_rows: int) -> list[str]:
    """Names of the rules by rejections per second on about `sample_rows` rows that pass the base test."""
    rows = docs.select(F.col(text).alias("text"))
    total = rows.count()
    if not total:
        return list(rules)
    sample = rows.sample(min(1.0, sample_rows / total), seed=1)
    names = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
        for batch in batches:
            for _, block in text_batches(batch, "text", BLOCK_BYTES):
                for data in block:
                    if Page(data).base_failed:
                        continue
                    for name in names:
                        page = Page(data)  # a new one: each rule pays for its own counts
                        began = time.perf_counter()
                        rejected[name] += rules[name](page)
                        spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[n] for n in names]), pa.array([rejected[n] for n in names])],
                                         names=["rule", "seconds", "rejected"])

    costs = (sample.mapInArrow(run, "rule string, seconds double, rejected long").groupBy("rule")
             .agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect())
    gain = {r.rule: ((r.rejected + 1) / (r.seconds + 1e-9)) for r in costs}
    return sorted(names, key=lambda n: (-gain.get(n, 0.0), n))


def judge(docs: DataFrame, *, keep: list[str], text: str = "text", rules: dict[str, Callable[[Page], bool]] | None = None,
          sample_rows: int = SAMPLE_ROWS, order: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with n_words, the base counts, base_failed, kept and rejected_by.

    rejected_by names the first rule, in the order of this run, that rejected the document (`base` for the base test,
    null if it is kept). A null text has no words and fails the base test, as an empty one does; repeated rows are judged
    alike; an empty table stays empty. Columns of docs named like a result must not be among `keep`.
    """
    rules = RULES if rules is None else rules
    order = measured_order(docs, text, rules, sample_rows) if order is None else order
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(*keep, F.col(text).alias("_op_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for _, block in text_batches(batch, "_op_text", BLOCK_BYTES):
                for data in block:
                    p = Page(data)
                    why = "base" if p.base_failed else next((n for n in order if rules[n](p)), None)
                    found.append((len(p.words), p.word_chars, p.symbols, p.lines[1], p.repeat_words, why == "base", why is None, why))
            if found:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, type=t) for c, t in zip(zip(*found), kinds))],
                                                 names=[*keep, *counts, "base_failed", "kept", "rejected_by"])

    schema = rows.select(*keep, *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(True).alias("base_failed"),
                         F.lit(True).alias("kept"), F.lit("").alias("rejected_by")).schema
    for field in schema.fields[-8:]:
        field.nullable = True
    return rows.mapInArrow(run, schema)
