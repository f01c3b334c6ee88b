"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Each task tokenises its documents and routes what remains of them behind full longest windows to tiers by length (powers
of two up to the longest context). Every tier is packed into windows of its own size, longest tier first: a document of
the tier opens a window, documents of shorter tiers fill its gap, longest fit first, and then the head of one more
document. So every window is full, whatever its size. A task holds one block of tokens at a time and cuts what is left
over at its end into powers of two, so padding does not depend on how many tasks there are. Only token counts and
checksums leave a task.

A training step takes windows of one size, as many as make the same number of tokens. All windows of a size are ranked by
their attention cost, on narrow rows in a range sort, and dealt to the steps back and forth, so that no step gets all the
costly ones.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import Stored

BLOCK_TOKENS = 1 << 20
ROWS_AT_ONCE = 128
END_ID = 1  # fixed value: the id behind each document
# Latin text, on which Python's classes of characters agree with the tokenizer's; other texts go through it whole
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ‐-‧‰-⁞]")
# fixed value: how byte_bpe_50k cuts text, for those characters; words first, which start like nothing else
_PIECES = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"
    r"| ?[0-9]+"
    r"|'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+"
    r"|\s+(?!\S)|\s+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, with the ids of pieces remembered up to a bound.

    `path` names a vocabulary as ranks. `added` names the tokenizer's JSON file: where one of its added tokens stands in
    a text, it is that token's id and cuts the text, as with `tokenizers`. Without it a text is ordinary throughout.
    """

    def __init__(self, path: str, remembered: int = 250_000, added: str | None = None):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.remembered = remembered
        self.added = added_tokens(added) if added else {}
        # longest first, as one token may begin another
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def _encode(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if not any(token in t for token in self.added for t in texts):
            return self._ordinary(texts)
        # ordinary parts and added tokens alternate
        parts = [self.cut.split(t) for t in texts]
        ordinary = iter(self._ordinary([part for own in parts for part in own[::2]]))
        return [b"".join(self.added[part] if k % 2 else next(ordinary) for k, part in enumerate(own)) for own in parts]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        pieces = [None if _UNUSUAL.search(t) else _PIECES.findall(t) for t in texts]
        unknown = set().union(*filter(None, pieces)).difference(self.known)
        if len(self.known) + len(unknown) > self.remembered:
            self.known.clear()
            unknown = set().union(*filter(None, pieces))
        self.known.update(zip(unknown, map(self._encode, unknown)))
        known = self.known.__getitem__
        return [self._encode(t) if p is None else b"".join(map(known, p)) for t, p in zip(texts, pieces)]


def added_tokens(path: str) -> dict[str, bytes]:
    """The added tokens of a tokenizer's JSON file with their ids."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError("added tokens that take blanks, stand alone or are normalised are not supported")
    return {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}


class Tiers:
    """Documents (or their tails) that wait, by tier and within it by length."""

    def __init__(self, smallest: int, longest: int):
        self.sizes = [1 << k for k in range(smallest.bit_length() - 1, longest.bit_length())]
        self.waiting: list[dict[int, deque]] = [{} for _ in self.sizes]
        self.lengths: list[list[int]] = [[] for _ in self.sizes]
        self.count = 0

    def tier(self, length: int) -> int:
        return next(t for t, size in enumerate(self.sizes) if length <= size)

    def add(self, length: int, part: tuple) -> None:
        t = self.tier(length)
        if length not in self.waiting[t]:
            self.waiting[t][length] = deque()
            self.lengths[t].insert(bisect_right(self.lengths[t], length), length)
        self.waiting[t][length].append(part)
        self.count += 1

    def take(self, most: int) -> tuple[int, tuple] | None:
        """The longest part of at most `most` tokens, from the tier of that size downwards."""
        for t in range(self.tier(most), -1, -1):
            at = bisect_right(self.lengths[t], most) - 1
            if at >= 0:
                length = self.lengths[t][at]
                queue = self.waiting[t][length]
                part = queue.popleft()
                if not queue:
                    del self.waiting[t][length]
                    self.lengths[t].pop(at)
                self.count -= 1
                return length, part
        return None

    def take_shortest(self) -> tuple[int, tuple]:
        return self.take(next(lengths[0] for lengths in self.lengths if lengths))


def packed(documents: list[tuple[int, int, int]], longest: int, smallest: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Sequences of pieces (document, start, length) and what is left over, from (document, first token, tokens).

    Sequences are full windows of the size of a tier; at the end of the input the rest is cut at powers of two, so that
    it needs no padding either.
    """
    sequences, tiers = [], Tiers(smallest, longest)
    for doc, first, tokens in documents:
        for start in range(first, tokens - longest + 1, longest):
            sequences.append([(doc, start, longest)])
        if rest := (tokens - first) % longest:
            tiers.add(rest, (doc, tokens - rest))
    for t in reversed(range(len(tiers.sizes))):
        while tiers.lengths[t]:  # the longest of the tier opens a window of its size
            room, window = tiers.sizes[t], []
            while room and (found := tiers.take(room)):
                length, (doc, start) = found
                window.append((doc, start, length))
                room -= length
            if room and tiers.count:  # nothing is short enough: the head of the shortest fills the gap
                length, (doc, start) = tiers.take_shortest()
                window.append((doc, start, room))
                tiers.add(length - room, (doc, start + room))
                room = 0
            if room == 0:
                sequences.append(window)
            elif not last:  # nothing waits any more
                return sequences, window
            else:
                sequences += cut_to_powers(window)
    return sequences, []


def cut_to_powers(sequence: list[tuple]) -> list[list[tuple]]:
    """The pieces of one unfilled sequence as sequences whose lengths are powers of two, longest first."""
    total, out, pieces = sum(p[2] for p in sequence), [], deque(sequence)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, part = 1 << bit, []
        while room:
            doc, start, length = pieces.popleft()
            part.append((doc, start, min(room, length)))
            if length > room:
                pieces.appendleft((doc, start + room, length - room))
            room -= part[-1][2]
        out.append(part)
    return out


def with_step_groups(pieces: DataFrame, store: Stored, per_step: int, longest: int) -> DataFrame:
    """Pieces with `step_group`: windows of one size dealt to steps of about `per_step * longest` tokens each.

    The windows of a size, ordered by cost (sum of squared piece lengths) and id, go to the steps back and forth; the
    numbers of windows of two steps of a size differ by one at most. The size stands in the upper bits of the number.
    """
    order = [F.col("sequence_length"), F.col("sequence_cost").desc(), F.col("sequence_id")]
    heads = pieces.where("offset = 0").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = store.put(heads.select("sequence_id", "sequence_length", F.monotonically_increasing_id().alias("place")))
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33))
    # a row for each partition and size in it: partitions and sizes together at most, as both are in order
    runs = placed.groupBy("sequence_length", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    size = Window.partitionBy("sequence_length")
    runs = runs.select("sequence_length", "part", "first", F.sum("n").over(size).alias("windows"),
                       (F.sum("n").over(size.orderBy("part")) - F.col("n")).alias("before"))
    ranked = placed.join(F.broadcast(runs), ["sequence_length", "part"]).select(
        "sequence_id", "sequence_length", (F.col("place") - F.col("first") + F.col("before")).alias("rank"),
        F.greatest(F.lit(1), F.expr(f"windows * sequence_length div {per_step * longest}")).alias("steps"))
    turn, at = F.expr("rank div steps"), F.col("rank") % F.col("steps")
    number = F.when(turn % 2 == 1, F.col("steps") - 1 - at).otherwise(at)
    steps = ranked.select("sequence_id", (F.shiftleft("sequence_length", 40) + number).alias("step_group"))
    return pieces.join(steps, "sequence_id").select(*pieces.columns, "step_group")


PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, sequence_cost long, tier int")


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", longest: int = 2048,  # noqa: A002
         smallest: int = 128, per_step: int = 16, added: str | None = None) -> DataFrame:
    """One row for each piece: the id, start and length in the document's ids, their CRC-32, and the place in a sequence.

    `tokenizer` and `added` are files as in Encoder. A document is its ids and the end id; a null text is empty and still has the end id. Every sequence is full or has
    a power of two as its length, so nothing is padded. Sequence ids hold the task's number in the upper bits; tier is
    the size of the shortest context that would hold the piece, sequence_cost the sum of the squared piece lengths of the
    sequence, step_group the step that the sequence is dealt to (`with_step_groups`). Repeated rows are packed each for itself; an id may be
    null; an empty table gives no pieces. Very long texts are cut into full sequences first.
    """
    if longest & (longest - 1) or smallest & (smallest - 1):
        raise ValueError("tiers are powers of two")
    schema = docs.select(F.col(id)).schema.simpleString()[7:-1].replace(f"{id}:", f"`{id}` ", 1) + ", " + PIECES
    kinds = [pa.int64()] * 8 + [pa.int32()]
    names = [id, *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer, added), TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # (id, ids, first id that is not packed yet)
        tokens, sequences_so_far = 0, 0
        end = array("I", [END_ID]).tobytes()
        id_type = None

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, tokens, sequences_so_far
            found, rest = packed([(k, first, len(ids) // 4) for k, (_, ids, first) in enumerate(held)], longest, smallest, last)
            rows, keys = [], []
            for number, sequence in enumerate(found):
                offset, size, cost = 0, sum(p[2] for p in sequence), sum(p[2] ** 2 for p in sequence)
                for k, start, length in sequence:
                    name, ids, _ = held[k]
                    keys.append(name)
                    rows.append((start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), len(ids) // 4, task + sequences_so_far + number,
                                 offset, size, cost, max(smallest, 1 << (length - 1).bit_length())))
                    offset += length
            sequences_so_far += len(found)
            # only the last pieces of documents wait for the next block; each is the end of its document
            held, tokens = [(held[k][0], held[k][1], start) for k, start, _ in rest], sum(p[2] for p in rest)
            if not rows:
                return None
            return pa.RecordBatch.from_arrays([pa.array(keys, type=id_type), *(pa.array(c, type=t) for c, t in zip(zip(*rows), kinds))], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                for name, ids in zip(part.column(0).to_pylist(), encoder.ids([t or "" for t in part.column(1).to_pylist()])):
                    held.append((name, ids + end, 0))
                    tokens += len(ids) // 4 + 1
                    if tokens >= BLOCK_TOKENS and (out := flush(False)):
                        yield out
        if held and (out := flush(True)):
            yield out

    store = Stored(docs.sparkSession, "packing")
    return with_step_groups(store.put(docs.select(F.col(id), F.col(text)).mapInArrow(run, schema)), store, per_step, longest)


_encoders: dict[tuple[str, str | None], Encoder] = {}


def _encoder(path: str, added: str | None) -> Encoder:
    """One encoder for a Python worker, which serves many tasks."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added=added)
    return _encoders[path, added]
