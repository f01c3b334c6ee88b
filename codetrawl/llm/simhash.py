"""SimHash near-dedup by segment popcounts.

A fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so fingerprints within two bits lie within Manhattan distance
two, and some cell of the grid is within distance one of both. Each distinct fingerprint is dealt to the cells within
distance one of its own (about 49); a cell with one fingerprint goes no further. In a cell the pairs are checked
exactly without forming them: two fingerprints differ by at most two bits if and only if one bit pattern is within one
bit of both, and that pattern's own cell is one they share. So the members of a cell meet at the one or two patterns
within a bit of them that lie in this cell, and each pattern links its members, 65 at most, to the smallest one.
The work is linear in the number of distinct fingerprints, however many copies or near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stored, connected_components, text_batches

BLOCK_BYTES = 1 << 20
SEED = 42  # fixed value: the seed of XXH64


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set, lowest bit first."""
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 4096):
        part = hashes[first:first + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return counts


def fingerprint(text: bytes, words: int) -> int:
    """Majority of the bits of the XXH64 of all shingles, repeats included; zero for a text without words."""
    tokens = text.lower().split()  # bytes: A to Z only, and blanks are 0x20, 0x09 to 0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    shingles = map(joined.__getitem__, map(slice, starts[: len(tokens) - size + 1].tolist(), ends[size - 1:].tolist()))
    hashes = np.fromiter(map(digest, shingles, repeat(SEED)), dtype=np.uint64, count=len(tokens) - size + 1)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, *, text: str = "text", words: int = 3, keep: list[str] | None = None,
                     name: str = "fingerprint") -> DataFrame:
    """The columns `keep` of docs (all by default) and the fingerprint as a signed 64-bit number."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows = docs.select(*[docs[c] for c in kept], docs[text].alias("_op_text"))
    schema = rows.select(*kept, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(data, words) for _, block in text_batches(batch, "_op_text", BLOCK_BYTES) for data in block]
            values = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*kept, name])

    return rows.mapInArrow(run, schema)


def embedded(value: Column) -> Column:
    """Bit counts of the 32 segments as numbers of two bits (half adders, so nothing can overflow)."""
    even = F.lit(0x5555555555555555)
    low, high = value.bitwiseAND(even), F.shiftrightunsigned(value, 1).bitwiseAND(even)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def near_patterns(value: Column) -> Column:
    """The value and the 64 values that differ by one bit."""
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    return F.transform(bits, lambda b: value.bitwiseXOR(b))


def in_company(dealt: DataFrame) -> DataFrame:
    """Distinct rows (cell, fp) whose cell holds another row; one shuffle and a sort, of which a task sees a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = fp = None  # the row before this batch, and whether it has gone out
        gone = True
        for batch in batches:
            cells, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(cells):
                continue
            same = np.zeros(len(cells) + 1, dtype=bool)  # is row i of the cell of row i - 1
            same[1:-1] = cells[1:] == cells[:-1]
            same[0] = cell is not None and cell == cells[0]
            company = same[:-1] | same[1:]
            out = cells[company], fps[company]
            if same[0] and not gone:
                out = np.append(out[0], cell), np.append(out[1], fp)
            cell, fp, gone = cells[-1], fps[-1], company[-1]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["cell", "fp"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, fp long")


def links(values: DataFrame) -> DataFrame:
    """(a, b) so that the components of these links are those of all pairs of distinct `fp` within two bits."""
    dealt = values.select(F.explode(F.array_distinct(F.transform(near_patterns(F.col("fp")), embedded))).alias("cell"), "fp")
    inside = F.filter(near_patterns(F.col("fp")), lambda pattern: embedded(pattern) == F.col("cell"))
    met = in_company(dealt).select("cell", F.explode(inside).alias("pattern"), "fp")
    # a pattern has 64 neighbours, so no group is larger than 65
    groups = met.groupBy("cell", "pattern").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def near_groups(prints: DataFrame, *, id: str = "doc_id", name: str = "fingerprint") -> DataFrame:  # noqa: A002
    """(fp, root, component_id): for each fingerprint its component (a fingerprint) and the smallest id in it.

    Ids that are null name no component unless all of its ids are null.
    """
    store = Stored(prints.sparkSession, "simhash")
    values = store.put(prints.groupBy(F.col(name).alias("fp")).agg(F.min(id).alias("least")))
    roots = connected_components(links(values), store).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    linked = store.put(values.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:  # noqa: A002
    """(id, fingerprint, component_id) for every row; component_id is the smallest id that two-bit links reach.

    A null or empty text has fingerprint zero and is linked like any other; repeated rows stay repeated; a null id is
    never a component's name while another id is there; an empty table gives an empty table.
    """
    store = Stored(docs.sparkSession, "fingerprints")
    prints = store.put(with_fingerprint(docs, text=text, words=words, keep=[id]))
    groups = near_groups(prints, id=id).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(groups, F.col("fingerprint") == F.col("_fp")).select(F.col(id), "fingerprint", "component_id")
