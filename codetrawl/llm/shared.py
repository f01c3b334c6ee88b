"""What several operators need: stored intermediate tables, word rules, hashing of text in numpy, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- stored tables ---------------------------------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of its own for a single-machine session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tables-"))
    return _own_folder[0]


class Stored:
    """Tables written once and read back: they cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._stored_path = path
        return back

    def drop(self, frame: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(frame, "_stored_path", None)
        if path and path.startswith(self.base):
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# -- columns ---------------------------------------------------------------------------------------------------------

def ascii_lower(text: Column) -> Column:
    """A to Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def column_or_null(frame: DataFrame, name: str, kind: str) -> Column:
    """The column of that name, or nulls if the frame has none."""
    return (frame[name] if name in frame.columns else F.lit(None)).cast(kind)


def text_batches(rows: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in blocks of limited size; null is the empty text. One text alone may be larger."""
    block: list[bytes] = []
    held, first = 0, 0
    values = rows.column(column).cast(pa.large_binary())
    for at, value in enumerate(values):
        data = value.as_py() or b""
        if block and held + len(data) > most_bytes:
            yield first, block
            block, held, first = [], 0, at
        block.append(data)
        held += len(data)
    if block:
        yield first, block


# -- rolling hashes over the bytes of many texts -----------------------------------------------------------------------



def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, np.uint64(base), dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads the information of all bits over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any slices of a byte array: H(i, j) depends on the bytes of [i, j) alone.

    Polynomial modulo 2**64 with a random 64-bit value for each byte; `seed` gives independent families.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1, 1 << 60)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = rng.integers(0, 1 << 64, size=256, dtype=np.uint64)
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _grow(self, count: int) -> None:
        if len(self.up) < count:
            self.up, self.down = _powers(self.base, count), _powers(self.inverse, count)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one more than bytes."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + end.astype(np.uint64) - start.astype(np.uint64))

    def sums_of(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Prefix sums over texts that lie one behind the other, with powers that start anew in each; for `between`."""
        self._grow(int(sizes.max(initial=0)) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        at = 0
        for size in sizes.tolist():
            out[at + 1:at + size + 1] = self.table[data[at:at + size]] * self.up[:size]
            at += size
        return np.cumsum(out, out=out)

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Hashes of slices [start, end) within texts that begin at `base`."""
        return mixed((sums[end] - sums[start]) * self.down[start - base] + (end - start).astype(np.uint64))

    def windows(self, sums: np.ndarray, size: int) -> np.ndarray:
        """For every position that has `size` bytes behind it."""
        count = max(len(sums) - size, 0)
        return mixed((sums[size:] - sums[:count]) * self.down[:count])


# -- words ------------------------------------------------------------------------------------------------------------

# fixed values: digits, A to Z in lower case and everything beyond ASCII are part of words
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


SEGMENT_BYTES = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts: `data` in lower case, byte ranges, hashes and the text of each word."""

    def __init__(self, rolling: Rolling, texts: list[bytes]):
        self.data = b" ".join(texts).lower()
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(sizes + 1) - sizes - 1
        parts = [self._segment(rolling, i, j) for i, j in self._segments()]
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts))
        self.owner = np.searchsorted(first, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def _segments(self) -> Iterator[tuple[int, int]]:
        """Ranges of limited size that end between words; only a word beyond the limit makes a longer one."""
        at = 0
        while len(self.data) - at > 2 * SEGMENT_BYTES:
            end = at + SEGMENT_BYTES
            while end < len(self.data) and _WORD[self.data[end]]:
                end += 1
            yield at, end
            at = end
        yield at, len(self.data)

    def _segment(self, rolling: Rolling, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = np.frombuffer(self.data, dtype=np.uint8, count=j - i, offset=i)
        edges = np.diff(np.concatenate([[False], _WORD[part], [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        return starts + i, ends + i, rolling.at(rolling.sums(part), starts, ends)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all runs of `size` words within one text."""
        count = len(self.hashes) - size + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        total = np.zeros(count, dtype=np.uint64)
        for k in range(size):
            total = total * _STEP + self.hashes[k:k + count]
        own = np.flatnonzero(self.owner[:count] == self.owner[size - 1:])
        return own, mixed(total[own] + np.uint64(size))

    def text(self, i: int, j: int) -> str:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[i:j], self.ends[i:j])).decode("utf-8", "replace")


# -- connected components ------------------------------------------------------------------------------------------------

def connected_components(edges: DataFrame, store: Stored, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Nodes are those of `edges`.

    Every round, a node takes the smallest grandparent among its neighbours and its own, and hands what it found to
    its parent (hooking and pointer jumping), so the number of rounds grows with the logarithm of a chain's length.
    Every round is aggregated before it is shuffled and written; the driver sees one count. Rows with a null end
    are left out; loops make a node of its own.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    both = store.put(pairs.union(pairs.select("b", "a")).distinct())
    parents = store.put(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("p"))
                        .select(F.col("a").alias("v"), "p", F.lit(None).cast(both.schema["a"].dataType).alias("was")))
    while True:
        child, parent = parents.select("v", "p"), parents.select(F.col("v").alias("p"), F.col("p").alias("gp"))
        grand = child.join(parent, "p")
        near = (both.join(grand.select(F.col("v").alias("b"), "gp"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("gp").alias("m")))
        nothing = F.lit(None).cast(both.schema["a"].dataType)
        offers = (grand.join(near, "v")
                  .select(F.explode(F.array(
                      F.struct(F.col("v"), F.least("gp", "m").alias("p"), F.col("p").alias("was")),
                      F.struct(F.col("p").alias("v"), F.least("gp", "m").alias("p"), nothing.alias("was")))).alias("o"))
                  .select("o.*"))
        after = store.put(offers.groupBy("v").agg(F.min("p").alias("p"), F.min("was").alias("was")))
        store.drop(parents)
        parents = after
        if not parents.where("p <> was").limit(1).count():
            store.drop(both)
            return parents.select(F.col("v").alias("node"), F.col("p").alias("component"))


# -- models ----------------------------------------------------------------------------------------------------------------

def averaged(parts: Iterable[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Mean of the models that tasks fitted, weighted by the rows each has seen."""
    parts = [p for p in parts if p["rows"] > 0]
    total = sum(p["rows"] for p in parts)
    return {k: sum(p[k] * (p["rows"] / total) for p in parts) for k in parts[0] if k != "rows"} if parts else {}
