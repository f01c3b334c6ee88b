"""Spelling variants: words within one inserted, deleted or replaced code point, by a dictionary of trie node pairs.

The words are sorted once as they are and once reversed. In such an order all words with one prefix are neighbours, so
the nodes of the trie are numbered in one walk, and a word becomes the numbers of its prefixes and of its suffixes.
Leaving out a position of a word gives a pair (prefix node, suffix node), and so does cutting a word between two
positions. Two words differ by a replaced code point if and only if they share a pair with that position left out in
both, and by an inserted one if and only if the longer with a position left out shares a pair with the shorter cut
there. A pair names one remaining string and one place, so a shared pair holds one word for each letter at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored, text_batches

LETTERS = "a-zÀ-ÿ"  # fixed value: what words are made of, after A to Z have been lower-cased
BLOCK_BYTES = 1 << 22
MOST_HELD = 400_000  # distinct words that a task holds before it hands their counts on
PART_BITS = 40  # numbers are (partition, count within it); a partition has fewer than 2**40 nodes
SPLIT, SKIP, SKIP_FIRST = 0, 1, 2


# -- words -----------------------------------------------------------------------------------------------------------

def long_runs(text: str, least: int) -> list[str]:
    """Maximal runs of at least `least` letters of a text in lower case (A to Z)."""
    return re.findall(f"[{LETTERS}]{{{least},}}", text)


def word_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_length: int = 7,  # noqa: A002
                typo_every: int | None = None) -> DataFrame:
    """(word, n): the words of at least `least_length` code points and how often they occur.

    `typo_every` plants typing errors: an occurrence whose CRC32 of "<id>:<word>" it divides loses the code point at that
    CRC32 modulo the word's length. Null texts have no words; a null id is written as nothing. Each task adds up its own
    words before they are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def counted(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            names = batch.column(0)
            for first, block in text_batches(batch, "text", BLOCK_BYTES):
                for k, data in enumerate(block):
                    found = long_runs(data.lower().decode("utf-8", "replace"), least_length)
                    if typo_every is None:
                        held.update(found)
                        continue
                    start = zlib.crc32(f"{names[first + k].as_py()}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % typo_every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                        held[word] += n
                if len(held) > MOST_HELD:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- trie nodes --------------------------------------------------------------------------------------------------------

def shared_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def numbered(rows: DataFrame, word: str, store: Stored) -> tuple[DataFrame, dict[int, int]]:
    """(`rows` sorted by `word` with _part, _at and _nodes, renamed nodes).

    _nodes are the numbers of the word's prefixes, the empty one first. A range of the order is numbered by its task alone; a
    prefix that began in an earlier range has a second number there, which the returned map leads to the first. Such
    prefixes lie on the path of a range's first word, so the driver sees two words of each range and nothing else.
    """
    ordered = rows.repartitionByRange(word).sortWithinPartitions(word)
    schema = rows.withColumns({"_part": F.lit(0).cast("long"), "_at": F.lit(0).cast("long"), "_nodes": F.array(F.lit(0).cast("long"))}).schema
    column = rows.columns.index(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, at, before, path = TaskContext.get().partitionId(), 0, 0, None, []
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                piece, nodes = batch.slice(begin, 4096), []
                for own in piece.column(column).to_pylist():
                    keep = 0 if before is None else shared_prefix(before, own) + 1
                    fresh = len(own) + 1 - keep
                    path = path[:keep] + list(range((part << PART_BITS) + count, (part << PART_BITS) + count + fresh))
                    count, before = count + fresh, own
                    nodes.append(path)
                extra = [pa.array(np.full(len(nodes), part)), pa.array(np.arange(at, at + len(nodes))), pa.array(nodes, pa.list_(pa.int64()))]
                at += len(nodes)
                yield pa.RecordBatch.from_arrays([*piece.columns, *extra], names=schema.names)

    stored = store.put(ordered.mapInArrow(run, schema))
    ends = stored.groupBy("_part").agg(*[f(F.struct("_at", F.col(word).alias("word"), F.col("_nodes").alias("nodes"))).alias(n)
                                         for n, f in (("first", F.min), ("last", F.max))]).collect()
    renamed: dict[int, int] = {}
    before = None
    for row in sorted(ends, key=lambda r: r["_part"]):
        if before is not None:
            for depth in range(shared_prefix(before["word"], row["first"]["word"]) + 1):
                there = before["nodes"][depth]
                renamed[row["first"]["nodes"][depth]] = renamed.get(there, there)
        before = row["last"]
    return stored, renamed


def _through(nodes: np.ndarray, renamed: dict[int, int]) -> np.ndarray:
    if not renamed:
        return nodes
    old = np.array(sorted(renamed), dtype=np.int64)
    new = np.array([renamed[x] for x in old.tolist()], dtype=np.int64)
    at = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
    return np.where(old[at] == nodes, new[at], nodes)


def pair_dictionary(words: DataFrame, forward: dict[int, int], backward: dict[int, int]) -> DataFrame:
    """(p, s, code) from (no, word, prefixes, suffixes): code is no * 4 and how the pair came about.

    Of equal code points in a row only the first is left out for the comparison with shorter words, so that no two
    words meet twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                piece = batch.slice(begin, 4096)
                no = piece.column(0).to_numpy()
                letters = "".join(piece.column(1).to_pylist()).encode("utf-32-le")
                points = np.frombuffer(letters, dtype=np.uint32)
                prefix = _through(piece.column(2).flatten().to_numpy(), forward)
                suffix = _through(piece.column(3).flatten().to_numpy(), backward)
                sizes = np.array([len(w) for w in piece.column(1).to_pylist()], dtype=np.int64)
                first = np.cumsum(sizes) - sizes  # of the word's code points; its nodes are one more
                owner = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(points)) - first[owner]
                base = first[owner] + owner
                new = np.append(True, points[1:] != points[:-1]) | (at == 0)
                skip = (prefix[base + at], suffix[base + sizes[owner] - 1 - at], no[owner] * 4 + np.where(new, SKIP_FIRST, SKIP))
                whole = np.repeat(np.arange(len(sizes)), sizes + 1)
                start = first + np.arange(len(sizes))
                cut = np.arange(len(whole)) - start[whole]
                split = (prefix, suffix[start[whole] + sizes[whole] - cut], no[whole] * 4 + SPLIT)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(skip, split)], names=["p", "s", "code"])

    return words.mapInArrow(run, "p long, s long, code long")


def shared_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b): each two words that are near, in both directions, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3

        def met(p: np.ndarray, s: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1]))[:len(p)]
            group = np.cumsum(new)
            left, right, step = [], [], 1
            while step < len(group):
                at = np.flatnonzero(group[step:] == group[:-step])
                if not len(at):
                    break
                x, y = code[at], code[at + step]
                kinds = (x & 3, y & 3)
                near = ((kinds[0] != SPLIT) & (kinds[1] != SPLIT)) | ((kinds[0] == SPLIT) & (kinds[1] == SKIP_FIRST)) | ((kinds[1] == SPLIT) & (kinds[0] == SKIP_FIRST))
                left.append(x[near] >> 2)
                right.append(y[near] >> 2)
                step += 1
            a, b = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (left, right))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in ((a, b), (b, a))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            p, s, code = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns))
            # the last pair may go on in the next batch; it holds one word for each letter at most
            last = int(np.flatnonzero((p != p[-1]) | (s != s[-1]))[-1:].sum() + 1) if (p[0], s[0]) != (p[-1], s[-1]) else 0
            rest = [x[last:].copy() for x in (p, s, code)]
            yield met(p[:last], s[:last], code[:last])
        yield met(*rest)

    return pairs.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(run, "a long, b long")


def last_forms(forms: DataFrame, store: Stored) -> DataFrame:
    """(no, root) from (no, form): where following the forms ends. Chains halve in every round."""
    ways = store.put(forms.select("no", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while ways.where("moved").limit(1).count():
        ahead = ways.select(F.col("no").alias("root"), F.col("root").alias("further"))
        after = store.put(ways.join(ahead, "root", "left").select(
            "no", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        store.drop(ways)
        ways = after
    return ways.select("no", "root")


def spelling_variants(counts: DataFrame, *, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words of `counts` (word, n) that occur at least `least_count` times.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. The form of a word is its near
    word of largest n (of equals the smallest in code-point order) if that n is at least `ratio` times its own, else null;
    root is where the forms end, or the word itself. Words are distinct and not null; other columns are not looked at; an
    empty table gives an empty table. Forms grow in n, so chains end. Work and memory are linear in a word's length.
    """
    store = Stored(counts.sparkSession, "spelling")
    known = counts.where(F.col("n") >= least_count).select("word", "n")
    sorted_words, forward = numbered(known, "word", store)
    # numbers follow the order of the words
    no = (F.shiftleft(F.col("_part"), PART_BITS) + F.col("_at")).alias("no")
    words = sorted_words.select(no, "word", "n")
    reversed_words, backward = numbered(words.select("no", F.reverse("word").alias("drow")), "drow", store)
    both = sorted_words.select(no, "word", F.col("_nodes").alias("prefixes")).join(reversed_words.select("no", F.col("_nodes").alias("suffixes")), "no")
    links = store.put(shared_pairs(pair_dictionary(both.select("no", "word", "prefixes", "suffixes"), forward, backward)))
    best = links.join(words.select(F.col("no").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("no")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
    near = store.put(words.join(best, "no").select("no", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form")))
    roots = last_forms(near.where("form is not null").select("no", "form"), store)
    named = near.where("form is not null").select("no", "form").join(roots, "no")
    named = (named.join(words.select(F.col("no").alias("form"), F.col("word").alias("_form"), F.col("n").alias("form_n")), "form")
             .join(words.select(F.col("no").alias("root"), F.col("word").alias("_root")), "root").select("no", "_form", "form_n", "_root"))
    return (words.join(near.select("no", "n_near"), "no", "left").join(named, "no", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_form").alias("form"), "form_n",
                    F.coalesce("_root", "word").alias("root")))
