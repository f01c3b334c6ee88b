"""Phrases of two to four words that occur more often together than apart, counted exactly for each language.

Texts become blocks of limited size: word codes with a dictionary of their own. Words are counted over all blocks, those
that occur often enough are numbered, and each block learns the numbers of its own words only, so no vocabulary is
broadcast. Then n-grams are counted for n = 2, 3, 4: each block sends counting quotient filters (quotient_filter) to the shards
of the quotient, a shard merges them and answers each block with one bit for each of its entries: whether it is frequent.
A phrase can only be frequent if its first and its last n - 1 words are, so the next round counts just those windows.
Parts of frequent phrases are frequent themselves, hence all counts that a score needs are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quotient_filter as qf
from .shared import Stored, text_batches

PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"  # fixed values
BOUNDARY = b"."  # stands for all ends of pieces; no word holds it
_TABLE = bytes(ord(BOUNDARY) if c in PIECE_ENDS else 32 if c in BLANKS else c for c in range(256))
LONGEST = 4
SEGMENT_BYTES = 1 << 20
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 21  # words of the whole input for each shard
SPREAD = 16  # copies of a word's row where phrases look it up, so that a common word is no hot key
RANK_BUCKETS = 64


# -- blocks of word codes ------------------------------------------------------------------------------------------------

class Codes(dict):
    """Numbers words as they come; `words` is shared by the languages of a block."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__()
        self.lang, self.words = lang, words
        self[BOUNDARY] = 0

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


def segments(data: bytes) -> Iterator[bytes]:
    """A prepared text in parts of limited size that end between words, and between pieces unless a piece is very long."""
    at = 0
    while len(data) - at > 2 * SEGMENT_BYTES:
        end = data.find(BOUNDARY, at + SEGMENT_BYTES, at + 8 * SEGMENT_BYTES)
        if end < 0:
            end = data.find(b" ", at + SEGMENT_BYTES)
        if end < 0:
            break
        yield data[at:end + 1]
        at = end + 1
    yield data[at:]


def blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows (block, codes) and rows (block, local, lang, word, n) for the words of each block."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    names = ["block", "codes", "local", "lang", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words: list[tuple[str, bytes]] = []
        known: dict[str, Codes] = {}
        held: list[np.ndarray] = []
        tokens = 0

        def finished() -> pa.RecordBatch:
            codes = np.concatenate(held)
            n = np.bincount(codes, minlength=len(words) + 1)[1:]
            nothing = [None] * len(words)
            columns = [pa.array([number] * (len(words) + 1), pa.int64()), pa.array([qf._planes(codes, 32), *nothing], pa.binary()),
                       pa.array([None, *range(1, len(words) + 1)], pa.int32()), pa.array([None, *(w[0] for w in words)], pa.string()),
                       pa.array([None, *(w[1] for w in words)], pa.binary()).cast(pa.string()), pa.array([None, *n.tolist()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            langs = batch.column(0)
            for first, block in text_batches(batch, "text", SEGMENT_BYTES):
                for k, data in enumerate(block):
                    own = langs[first + k].as_py()
                    prepared = data.lower().translate(_TABLE) + BOUNDARY
                    for part in segments(prepared):
                        split = part.replace(BOUNDARY, b" . ").split()
                        if own not in known:
                            known[own] = Codes(own, words)
                        held.append(np.fromiter(map(known[own].__getitem__, split), dtype=np.int64, count=len(split)))
                        tokens += len(split)
                        if tokens >= BLOCK_TOKENS and len(split) and split[-1] == BOUNDARY:
                            yield finished()
                            number, tokens, words, known, held = number + 1, 0, [], {}, []
        if tokens:
            yield finished()

    return rows.mapInArrow(run, "block long, codes binary, local int, lang string, word string, n long")


def unsent(rows: DataFrame) -> DataFrame:
    """The right side of a join that never goes through the driver: Spark judges by the size of files, which says little of rows
    that they hold compressed and that are repeated SPREAD times."""
    return rows.hint("merge")


def vocabulary(coded: DataFrame, least: int, store: Stored) -> DataFrame:
    """(lang, word, n, id): the words that occur at least `least` times in a language, numbered from 1 without gaps."""
    often = coded.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    placed = store.put(often.withColumn("place", F.monotonically_increasing_id()))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = (placed.groupBy(part.alias("part")).agg((F.max(row) + 1).alias("rows"))
              .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    return placed.join(F.broadcast(starts), part == F.col("part")).select("lang", "word", "n", (F.col("start") + row + 1).alias("id"))


# -- rounds --------------------------------------------------------------------------------------------------------------

def windows(sequence: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of `size` words without a gap (0)."""
    count = len(sequence) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    gaps = np.cumsum(np.append(0, sequence == 0))
    return np.flatnonzero(gaps[size:] == gaps[:count])


def narrowed(sequence: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A sequence whose windows of `size` words are those that begin at `starts`, in order; gaps are 0."""
    if not len(starts):
        return np.zeros(0, dtype=sequence.dtype)
    breaks = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = starts[np.append(0, breaks)], starts[np.append(breaks, len(starts)) - 1] + size
    lengths = last - first + 1  # one place for the gap
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) - np.repeat(ends - lengths - first, lengths)
    out = sequence[np.minimum(at, len(sequence) - 1)].copy()
    out[ends - 1] = 0
    return out


def _entries(sequence: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, ...]:
    """(starts, left, right, counts, entry of each start) of the windows of a sequence."""
    starts = windows(sequence, size)
    left, right = qf.packed([sequence[starts + k] for k in range(size)], bits)
    return (starts, *qf.distinct(*qf.permuted(left, right, qf.widths(size, bits))))


ROUND = "block long, shard long, filter binary, sequence binary"


def _sent(block: int, sequence: np.ndarray, size: int, bits: int, shard_bits: int) -> pa.Table:
    """The filters of a block and the sequence that they were made of."""
    wide = qf.widths(size, bits)
    _, left, right, counts, _ = _entries(sequence, size, bits)
    shard_of = left >> np.uint64(wide[0] - shard_bits)
    shards, first = np.unique(shard_of, return_index=True)
    filters = [qf.encoded(left[i:j], right[i:j], counts[i:j], int(s), shard_bits, wide)
               for s, i, j in zip(shards.tolist(), first.tolist(), np.append(first[1:], len(left)).tolist())]
    rows = len(filters)
    if not rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["block", "shard", "filter", "sequence"])
    return pa.table([pa.array([block] * (rows + 1), pa.int64()), pa.array([*shards.astype(np.int64).tolist(), None], pa.int64()),
                     pa.array([*filters, None], pa.binary()), pa.array([None] * rows + [qf._planes(sequence, bits)], pa.binary())],
                    names=["block", "shard", "filter", "sequence"])


def first_round(coded: DataFrame, words: DataFrame, bits: int, shard_bits: int) -> DataFrame:
    """Filters of pairs of words; words that are not frequent are gaps."""
    own = coded.where("word is not null").select("block", "local", "lang", "word").join(unsent(words.select("lang", "word", "id")), ["lang", "word"])

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        data = left.column("codes")[0].as_py() if left.num_rows else b""
        codes, _ = qf._from_planes(data, 0, len(data) // 4, 32)
        codes = codes.astype(np.int64)
        local, ids = (right.column(c).to_numpy() for c in ("local", "id"))
        number = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int64)
        number[local] = ids
        sequence = number[codes]
        return _sent(key[0].as_py(), narrowed(sequence, windows(sequence, 2), 2), 2, bits, shard_bits)

    codes = coded.where("codes is not null").select("block", "codes")
    return codes.groupBy("block").cogroup(own.select(F.col("block").alias("of"), "local", "id").groupBy("of")).applyInArrow(work, ROUND)


def next_round(rows: DataFrame, merged: DataFrame, size: int, bits: int, shard_bits: int) -> DataFrame:
    """Filters of the windows of `size` words whose two windows of one word less are frequent."""
    before = size - 1

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent(0, np.zeros(0, dtype=np.int64), size, bits, shard_bits)
        data = left.column("sequence")[0].as_py()
        sequence, _ = qf._from_planes(data, 0, len(data) // -(-bits // 8), bits)
        sequence = sequence.astype(np.int64)
        starts, halves, _, _, entry = _entries(sequence, before, bits)
        shard_of = (halves >> np.uint64(qf.widths(before, bits)[0] - min(shard_bits, bits))).astype(np.int64)
        often = np.zeros(len(halves), dtype=bool)
        for shard, verdict in zip(right.column("shard").to_pylist(), right.column("verdict").to_pylist()):
            i, j = np.searchsorted(shard_of, [shard, shard + 1])
            often[i:j] = np.unpackbits(np.frombuffer(verdict, dtype=np.uint8), count=j - i).astype(bool)
        kept = starts[often[entry]]
        both = kept[:-1][np.diff(kept) == 1]
        return _sent(key[0].as_py(), narrowed(sequence, both, size), size, bits, shard_bits)

    sequences = rows.where("sequence is not null").select("block", "sequence")
    verdicts = merged.where("verdict is not null").select(F.col("block").alias("of"), "shard", "verdict")
    return sequences.groupBy("block").cogroup(verdicts.groupBy("of")).applyInArrow(work, ROUND)


def merged_filters(rows: DataFrame, size: int, bits: int, least: int) -> DataFrame:
    """Rows (w1 .. w4, f) of the frequent n-grams and rows (block, shard, verdict) for the blocks that hold some."""
    wide = qf.widths(size, bits)
    names = ["block", "shard", "verdict", *(f"w{k + 1}" for k in range(LONGEST)), "f"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * (LONGEST + 1)]

    def work(table: pa.Table) -> pa.Table:
        parts = [qf.decoded(x.as_py()) for x in table.column("filter")]
        left, right, counts, entry = qf.distinct(*(np.concatenate(x) for x in zip(*parts)))
        often = counts >= least
        words = qf.unpacked(*qf.restored(left[often], right[often], wide), size, bits)
        answers, at = [], 0
        for block, shard, part in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), parts):
            own = often[entry[at:at + len(part[0])]]
            at += len(part[0])
            if own.any():
                answers.append((block, shard, np.packbits(own).tobytes()))
        m, none = int(often.sum()), [None] * len(answers)
        first = [[a[k] for a in answers] + [None] * m for k in range(3)]
        numbers = [*[w.tolist() for w in words], *[[0] * m] * (LONGEST - size), counts[often].tolist()]
        return pa.table([pa.array(x, t) for x, t in zip([*first, *[none + x for x in numbers]], kinds)], names=names)

    schema = "block long, shard long, verdict binary, " + ", ".join(f"w{k + 1} long" for k in range(LONGEST)) + ", f long"
    return rows.where("filter is not null").select("block", "shard", "filter").groupBy("shard").applyInArrow(work, schema)


# -- scores --------------------------------------------------------------------------------------------------------------

def _looked_up(rows: DataFrame, parts: DataFrame, side: str, name: str) -> DataFrame:
    """`rows` with the count of the part <side>1 .. <side>3; rows of single words are spread over copies of the word."""
    key = [f"{side}{k}" for k in (1, 2, 3)]
    single = F.col(key[1]) == 0
    salted = rows.withColumn("_salt", F.when(single, F.pmod(F.xxhash64("w1", "w2", "w3", "w4"), F.lit(SPREAD))).otherwise(0))
    right = parts.select(*[F.col(f"p{k}").alias(c) for k, c in zip((1, 2, 3), key)], F.col("f").alias(name), F.col("salt").alias("_salt"))
    return salted.join(unsent(right), [*key, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, contained: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to four words.

    A phrase lies within a piece of text between `.,;:!?` and line ends and occurs a >= `least` times in its language; l and r are
    the occurrences of the two parts of its weakest cut, n all words of the language, score is floor(2000000 * a / (l + r)) in
    decimal arithmetic. A phrase inside a longer one that occurs at least `contained` percent as often is left out. Ties go by
    a, then by the phrase in byte order, so ranks are unique. Null texts are empty; a null language is `und`; repeated rows
    count again; a table without frequent phrases gives no rows; other columns are not looked at.
    """
    store = Stored(docs.sparkSession, "collocations")
    coded = store.put(blocks(docs, text, lang))
    totals = store.put(coded.where("word is not null").groupBy("lang").agg(F.sum("n").alias("n")))
    words = store.put(vocabulary(coded, least, store))
    # two numbers: how many words there are, and how many are frequent
    seen = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(1, int(words.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]).bit_length())
    shard_bits = min(bits, max(0, (seen // SHARD_TOKENS).bit_length()))
    found = []
    rows = store.put(first_round(coded, words, bits, shard_bits))
    for size in range(2, LONGEST + 1):
        merged = store.put(merged_filters(rows, size, bits, least))
        found.append(merged.where("f is not null").select(F.lit(size).alias("size"), "w1", "w2", "w3", "w4", "f"))
        if size < LONGEST:
            after = store.put(next_round(rows, merged, size + 1, bits, shard_bits))
            store.drop(rows)
            rows = after
    phrases = found[0].union(found[1]).union(found[2])

    zero = F.lit(0).cast("long")
    singles = words.select(F.col("id").alias("p1"), zero.alias("p2"), zero.alias("p3"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    parts = singles.union(phrases.where(F.col("size") < LONGEST).select("w1", "w2", "w3", "f", F.lit(0)))

    def cut(first: list[str], rest: list[str], after: int) -> Column:
        def padded(names: list[str], side: str) -> list[Column]:
            return [(F.col(names[k]) if k < len(names) else zero).alias(f"{side}{k + 1}") for k in range(3)]
        return F.struct(F.lit(after).alias("k"), *padded(first, "x"), *padded(rest, "y"))

    cuts = None
    for size in range(2, LONGEST + 1):
        names = [f"w{k + 1}" for k in range(size)]
        own = phrases.where(F.col("size") == size).select("size", "w1", "w2", "w3", "w4", "f", F.explode(F.array(*[cut(names[:k], names[k:], k) for k in range(1, size)])).alias("c"))
        cuts = own if cuts is None else cuts.union(own)
    cuts = cuts.select("size", "w1", "w2", "w3", "w4", "f", "c.*")
    both = _looked_up(_looked_up(cuts, parts, "x", "l"), parts, "y", "r")
    score = F.expr("(cast(f as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    scored = both.groupBy("size", "w1", "w2", "w3", "w4", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = [F.struct(*[(F.col(f"w{at + k + 1}") if k < n else zero).alias(f"w{k + 1}") for k in range(LONGEST)], F.lit(size).alias("from"))
             for size in (3, 4) for n in range(2, size) for at in range(size - n + 1)]
    inside = (phrases.where("size > 2").select("f", "size", F.explode(F.array(*inner)).alias("i")).where("size = i.from")
              .groupBy("i.w1", "i.w2", "i.w3", "i.w4").agg(F.max("f").alias("longer")))
    key = ["w1", "w2", "w3", "w4"]
    kept = store.put(scored.join(unsent(inside), key, "left").where(F.expr(f"longer is null or 100 * longer < {int(contained)} * f")).select("size", *key, "f", "best"))

    spread_words = words.select(F.col("id").alias("w"), "lang", "word", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    spelled = (kept.select(*key, F.posexplode(F.array(*key)).alias("at", "w")).where("w <> 0")
               .withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SPREAD)).cast("int")).join(unsent(spread_words), ["w", "salt"])
               .groupBy(*key).agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws")))
    named = kept.join(unsent(spelled), key).select("lang", F.array_join("ws.word", " ").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    in_bucket = Window.partitionBy("lang", "bucket").orderBy(*order)
    few = named.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))).withColumn("rank", F.row_number().over(in_bucket)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
