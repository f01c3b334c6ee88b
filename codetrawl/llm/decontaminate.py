"""Benchmark decontamination: a prefix-filtered set join with exact windows.

An item is cut into windows of `window` words (a shorter item is one window), a window into shingles. A document that
contains a window contains all of its shingles, so one necessary prefix token is enough to find it: the shingle of the
window that is rarest in the documents. Documents are searched for prefix tokens only; each occurrence, moved by the
token's place in its window, is a candidate that must fit into the document (length and positional bounds) and must
then repeat the window word by word. Two passes read the documents, one to count and one to find; neither moves texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Rolling, Stored, Words, text_batches

BLOCK_BYTES = 1 << 18  # hashing takes some 60 times that in each task
FILTER_BITS = 23  # one megabyte in each task, whatever the size of the benchmark; a full filter passes everything on

def item_windows(items: DataFrame, *, id: str, text: str, window: int, shingle: int) -> DataFrame:  # noqa: A002
    """(item_id, window, size, at, token): every shingle of every window, `at` words behind its start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, block in text_batches(batch, "text", BLOCK_BYTES):
                words = Words(rolling, block)
                out: list[tuple] = []
                for size in range(1, shingle + 1):
                    places, tokens = words.shingles(size)
                    token_at = dict(zip(places.tolist(), tokens.view(np.int64).tolist()))
                    for k in range(len(block)):
                        i, j = int(words.bounds[k]), int(words.bounds[k + 1])
                        length = min(window, j - i)
                        if min(length, shingle) != size:
                            continue
                        for start in range(i, j - length + 1):
                            said = words.text(start, start + length)
                            out += [(ids[first + k], said, length, at, token_at[start + at]) for at in range(length - size + 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)

    names, kinds = ["item_id", "window", "size", "at", "token"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    rows = items.select(F.col(id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item_id string, window string, size int, at int, token long")


def token_filter(tokens: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which the bit of every token is set."""
    place = F.shiftrightunsigned("token", 64 - FILTER_BITS)
    words = (tokens.select(F.shiftrightunsigned(place, 6).alias("word"),
                           F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def passing(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[(tokens >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])


def token_counts(docs: DataFrame, text: str, sizes: list[int], table: np.ndarray) -> DataFrame:
    """(token, found): how often tokens that pass the filter occur in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, bits = Rolling(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, block in text_batches(batch, "text", BLOCK_BYTES):
                words = Words(rolling, block)
                for size in sizes:
                    _, tokens = words.shingles(size)
                    kinds, found = np.unique(tokens[passing(tokens, bits)], return_counts=True)
                    if len(kinds):
                        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(found)], names=["token", "found"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "token long, found long")
    return counts.groupBy("token").agg(F.sum("found").alias("found"))


def token_places(docs: DataFrame, text: str, sizes: list[int], table: np.ndarray, window: int, kept: list[str]) -> DataFrame:
    """The columns `kept`, n_words and places: for each token that passes the filter its place and the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))
    place = pa.list_(pa.struct([("place", pa.int64()), ("token", pa.int64()), ("first", pa.int64()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, bits = Rolling(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for first, block in text_batches(batch, "_op_text", BLOCK_BYTES):
                words = Words(rolling, block)
                found: list[list[dict]] = [[] for _ in block]
                for size in sizes:
                    places, tokens = words.shingles(size)
                    for k in passing(tokens, bits).tolist():
                        at, owner = int(places[k]), int(words.owner[places[k]])
                        low, high = int(words.bounds[owner]), int(words.bounds[owner + 1])
                        i, j = max(low, at - window + size), min(high, at + window)
                        found[owner].append({"place": at - low, "token": int(tokens[k].view(np.int64)), "first": i - low, "around": words.text(i, j)})
                rows = batch.slice(first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], pa.array(np.diff(words.bounds)), pa.array(found, type=place)],
                    names=[*rows.schema.names[:-1], "_op_words", "_op_places"])

    rows = docs.select(*kept, F.monotonically_increasing_id().alias("_op_row"), F.col(text).alias("_op_text"))
    schema = rows.drop("_op_text").select(
        "*", F.lit(0).cast("long").alias("_op_words"),
        F.lit(None).cast("array<struct<place:long,token:long,first:long,around:string>>").alias("_op_places")).schema
    return rows.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """For every document the columns `keep` with n_words, n_hit, items (sorted ids as strings), n_items and contaminated.

    n_hit counts words inside any occurrence of a window. Null and wordless texts have no words and no windows; an item
    with a null id hits, but is not listed; equal items are all listed; repeated documents stay repeated. With an
    empty benchmark nothing is hit; with no documents the result is empty. Columns of docs named like a result must
    not be among `keep`.
    """
    spark = docs.sparkSession
    store = Stored(spark, "contamination")
    shingles = store.put(item_windows(benchmark, id=item_id, text=item_text, window=window, shingle=shingle))
    sizes = sorted(r[0] for r in shingles.select(F.least("size", F.lit(shingle))).distinct().collect())
    counts = token_counts(docs, text, sizes, token_filter(shingles.select("token")))
    rarest = (shingles.select("window", "size", "at", "token").distinct().join(counts, "token", "left")
              .groupBy("window", "size").agg(F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "token", "at")).alias("r"))
              .where("r.found > 0"))
    prefixes = store.put(rarest.select("window", "size", F.col("r.token").alias("token"), F.col("r.at").alias("at")))
    places = store.put(token_places(docs, text, sizes, token_filter(prefixes.select("token")), window, keep))

    candidates = (places.where(F.size("_op_places") > 0)
                  .select("_op_row", "_op_words", F.explode("_op_places").alias("c")).select("_op_row", "_op_words", "c.*"))
    start = F.col("place") - F.col("at")
    fits = (candidates.join(prefixes, "token").withColumn("start", start)
            .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("_op_words"))))
    said = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("size")), " ")
    hits = store.put(fits.where(said == F.col("window")).select("_op_row", "start", "size", "window").distinct())

    order = Window.partitionBy("_op_row").orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    words = (hits.select("_op_row", "start", "size").distinct()
             .withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0)))))
             .groupBy("_op_row").agg(F.sum("new").cast("long").alias("n_hit")))
    owners = shingles.select("window", "item_id").distinct()
    items = (hits.select("_op_row", "window").distinct().join(owners, "window").where("item_id is not null")
             .groupBy("_op_row").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    found = words.join(items, "_op_row", "left")
    out = places.select("_op_row", *keep, F.col("_op_words").alias("n_words")).join(found, "_op_row", "left")
    return out.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
