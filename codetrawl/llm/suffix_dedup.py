"""Removal of long byte strings that occur more than once, by suffix arrays over groups of candidates.

Every string of `length` bytes has a canonical anchor, the gram of GRAM bytes in it with the smallest hash. Equal strings
have equal anchors, so occurrences can meet by the anchor's hash; runs of strings with one anchor (some 150) are one
row. Anchors that occur once end there. Runs of equal bytes need no more than a comparison of their hashes. What
remains are different contexts around one anchor: they are fetched once each, gathered by anchor, and each task sorts
its contexts' suffixes. Contexts are cut at places that four bytes decide, chunks become symbols in the order of their
bytes, and a suffix array by Lyndon groups (suffix_groups) orders the chunk suffixes; the order of all strings follows
from the bytes before their first chunk and the rank behind them. Neighbours in that order are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, Stored, text_batches
from .suffix_groups import ranks

GRAM = 96
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 22
CONTEXT_BYTES = 1 << 18  # contexts that are sorted together, complete anchors only
KEYS = ["k1", "k2"]


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest of each `size` values in a row, the first of equals (to 40 bits)."""
    n = len(values)
    places = np.arange(n, dtype=np.uint64)
    keys = (values & np.uint64(0xFFFFFFFFFF000000)) | places
    padded = np.full(-(-n // size) * size, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - size + 1
    return (np.minimum(behind[:count], ahead[size - 1:size - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchor_runs(texts: list[bytes], length: int, grams: Rolling, contexts: Rolling) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, anchor, context): strings that start in lo..hi share an anchor; context hashes all their bytes."""
    out = []
    pieces: list[tuple[int, int, bytes]] = []

    def work() -> None:
        data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
        if len(data) < length:
            return
        sizes = np.array([len(p[2]) for p in pieces])
        first = np.cumsum(sizes) - sizes
        hashes = grams.windows(grams.sums(data), GRAM)
        place = sliding_least(hashes, length - GRAM + 1)
        # strings that would cross from one piece to the next do not count
        valid = np.zeros(len(place) + 1, dtype=np.int8)
        own = np.flatnonzero(sizes >= length)
        np.add.at(valid, first[own], 1)
        np.add.at(valid, first[own] + sizes[own] - length + 1, -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = np.append(True, place[1:] != place[:-1])
        new[first[own]] = True
        start = valid & (new | ~np.append(False, valid[:-1]))
        stop = valid & np.append(new[1:] | ~valid[1:], True)
        lo, hi = np.flatnonzero(start), np.flatnonzero(stop)
        owner_of = np.searchsorted(first, lo, side="right") - 1
        shift = np.array([p[1] for p in pieces])[owner_of] - first[owner_of]
        around = contexts.at(contexts.sums(data), lo, hi + length)
        out.append((np.array([p[0] for p in pieces])[owner_of], lo + shift, hi + shift, hashes[place[lo]], around))

    held = 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), PIECE_BYTES):
            part = text[at:at + PIECE_BYTES + length - 1]
            pieces.append((k, at, part))
            held += len(part)
            if held >= BLOCK_BYTES:
                work()
                pieces, held = [], 0
    if pieces:
        work()
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def runs_of(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi, anchor, context) from (k1, k2, text); a text that a task has seen before is not repeated."""
    names = [*KEYS, "lo", "hi", "anchor", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, contexts, seen = Rolling(21), Rolling(22), set()
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in range(2))
            for first, block in text_batches(batch, "text", BLOCK_BYTES):
                if len(seen) > 1_000_000:
                    seen.clear()
                for k in range(len(block)):
                    key = (k1[first + k], k2[first + k])
                    if key in seen:
                        block[k] = b""
                    seen.add(key)
                who, lo, hi, anchor, context = anchor_runs(block, length, grams, contexts)
                who = who + first
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[who], k2[who], lo, hi, anchor.view(np.int64), context.view(np.int64))], names=names)

    return texts.select(*KEYS, "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_strings(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context which of its strings of `length` bytes (by start) occur elsewhere in these contexts."""
    whole = b"".join(contexts)
    data = np.frombuffer(whole, dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    first = np.cumsum(sizes) - sizes
    # chunks begin behind four bytes whose hash says so, and at the beginning of a context
    four = np.zeros(len(data), dtype=np.uint32)
    for step, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
        four[4:] += data[step:len(data) - 4 + step] * np.uint32(factor)
    four ^= four >> np.uint32(15)
    four *= np.uint32(0x2C1B3C6D)
    cut = four >> np.uint32(28) == 0
    del four
    for k in range(4):
        cut[(first + k)[first + k < len(data)]] = False
    chosen = np.flatnonzero(cut).astype(np.int32)
    bounds = np.union1d(first, chosen)
    owner = np.searchsorted(first, bounds, side="right") - 1
    ends = np.append(bounds[1:], len(data))
    chunks = [whole[i:j] for i, j in zip(bounds.tolist(), ends.tolist())]
    number = {c: k for k, c in enumerate(sorted(set(chunks)))}
    # every context ends with a symbol of its own, smaller than all chunks
    begins = np.searchsorted(bounds, first)
    symbols: list[int] = []
    for k, (i, j) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), len(bounds)])):
        symbols += [number[c] for c in chunks[i:j]]
        symbols.append(k - len(contexts))
    del chunks, number
    rank_at = np.full(len(data) + 1, -1, dtype=np.int32)
    rank_at[bounds] = ranks(symbols)[np.arange(len(bounds)) + owner]

    short = np.zeros(len(data), dtype=bool)  # starts too close to the end of a context
    for i, n in zip(first.tolist(), sizes.tolist()):
        short[i + max(n - length + 1, 0):i + n] = True
    starts = np.flatnonzero(~short).astype(np.int32)
    # the first chunk that begins at least four bytes behind the start, if it lies within the string
    behind = starts + np.int32(length)
    if len(chosen):
        at = np.searchsorted(chosen, starts + np.int32(4))
        near = np.where(at < len(chosen), chosen[np.minimum(at, len(chosen) - 1)], np.int32(len(data)))
        inside = near < behind
        behind = np.where(inside, near, behind)
    else:
        inside = np.zeros(len(starts), dtype=bool)
    rolling, base = Rolling(23), np.repeat(first, sizes)[starts].astype(np.int32)
    sums = rolling.sums_of(data, sizes)
    head = rolling.between(sums, starts, behind, base)
    order = np.lexsort((np.where(inside, rank_at[behind], -1), head))
    del head
    full = rolling.between(sums, starts, starts + np.int32(length), base)[order]
    same = np.flatnonzero(full[:-1] == full[1:])
    here, there = starts[order[same]], starts[order[same + 1]]
    again = np.zeros(len(data), dtype=bool)
    for i, j in zip(here.tolist(), there.tolist()):
        if whole[i:i + length] == whole[j:j + length]:
            again[i] = again[j] = True
    return [again[i:i + max(n - length + 1, 0)] for i, n in zip(first.tolist(), sizes.tolist())]


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of True."""
    edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()))


def fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, context, bytes) for the runs in `wanted`; a task gives each context once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for text, runs in zip(batch.column(0), batch.column(1)):
                data, rows = (text.as_py() or b""), []
                for r in runs.as_py():
                    if (key := (r["anchor"], r["context"])) not in seen:
                        seen.add(key)
                        rows.append((*key, data[r["lo"]:r["hi"] + length]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                                                     names=["anchor", "context", "bytes"])

    lists = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("lo", "hi", "anchor", "context")).alias("runs"))
    return (texts.join(lists, KEYS).select(F.col("text").cast("binary").alias("text"), "runs")
            .mapInArrow(run, "anchor long, context long, bytes binary"))


def judged(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, first, last): strings of a context that occur in another context of the same anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            rows = []
            for (anchor, context, _), flags in zip(held, repeated_strings([h[2] for h in held], length)):
                rows += [(anchor, context, i, j) for i, j in spans_of(flags)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in range(4)], names=["anchor", "context", "first", "last"])

        for batch in batches:
            for anchor, context, data in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and anchor != last[0] and size >= CONTEXT_BYTES:
                    yield solved()
                    held, size = [], 0
                if (anchor, context) != last:
                    held.append((anchor, context, data))
                    size += len(data)
                    last = (anchor, context)
        if held:
            yield solved()

    return (contexts.repartition("anchor").sortWithinPartitions("anchor", "context")
            .mapInArrow(run, "anchor long, context long, first long, last long"))


def cut_out(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) for texts (unique keys) with spans (first byte, end)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data, kept, at, removed, runs = text.as_py() or b"", [], 0, 0, 0
                for r in own.as_py():
                    first, end = max(r["first"], at), r["end"]
                    if r["first"] > at or (runs == 0):
                        runs += 1
                        kept.append(data[at:first])
                    removed += max(0, end - first)
                    at = max(at, end)
                rows.append((k1, k2, removed, runs, b"".join(kept) + data[at:]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=[*KEYS, "n_removed", "n_spans", "kept"])

    lists = spans.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))
    return (texts.join(lists, KEYS).select(*KEYS, F.col("text").cast("binary").alias("text"), "spans")
            .mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary"))


def without_repeats(docs: DataFrame, *, keep: list[str], text: str = "text", length: int = 400, digest: bool = False) -> DataFrame:
    """The columns `keep` of docs with n_bytes, n_removed, n_spans and the bytes that are kept.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in this or another document.
    `digest` gives kept_sha256 instead of `kept` (binary). Null texts are empty; repeated rows are copies of each other and lose
    all if they are long enough; an empty table stays empty. Columns of docs named like a result must not be among `keep`.
    """
    store = Stored(docs.sparkSession, "suffix_dedup")
    # equal texts share 128 bits
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))).alias("k2"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    long_texts = texts.where(F.octet_length("text") >= length)
    copies = store.put(long_texts.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS))

    runs = store.put(runs_of(long_texts, length))
    place = F.xxhash64("k1", "k2", "lo")
    often = store.put(runs.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("anchor"))
    near = store.put(runs.join(often, "anchor", "left_semi"))
    store.drop(runs)
    kinds = store.put(near.groupBy("anchor", "context").agg(
        (F.min(place) != F.max(place)).alias("again"), *[F.first(c).alias(c) for c in (*KEYS, "lo", "hi")]))
    mixed_anchors = kinds.groupBy("anchor").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a <> b").select("anchor")
    wanted = store.put(kinds.join(mixed_anchors, "anchor", "left_semi"))
    sorted_out = judged(fetched(long_texts, wanted.select(*KEYS, "lo", "hi", "anchor", "context"), length), length)
    found = store.put(kinds.where("again").select("anchor", "context", F.lit(0).cast("long").alias("first"), (F.col("hi") - F.col("lo")).alias("last"))
                      .union(sorted_out).dropDuplicates())
    spans = (near.join(copies, KEYS, "left_anti").join(found, ["anchor", "context"])
             .select(*KEYS, (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last") + length).alias("end")))
    cut = cut_out(long_texts, spans)
    empty = F.lit(b"").cast("binary")
    cut = cut.select(*KEYS, "n_removed", "n_spans", F.sha2("kept", 256).alias("_kept") if digest else F.col("kept").alias("_kept"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest()) if digest else empty
    results = store.put(cut.withColumn("_all", F.lit(False)).union(
        copies.select(*KEYS, F.lit(0).cast("long"), F.lit(1).cast("long"), nothing, F.lit(True))))

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"), F.octet_length(whole).cast("long").alias("n_bytes"),
                       (F.sha2(whole, 256) if digest else whole.cast("binary")).alias("_whole"))
    out = rows.join(results, KEYS, "left")
    return out.select(*keep, "n_bytes", F.when(F.col("_all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("_kept", "_whole").alias("kept_sha256" if digest else "kept"))
