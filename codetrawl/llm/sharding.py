"""Sharding by balanced label propagation.

Documents start in shards of nearly equal size. In every round a document that has neighbours proposes to move to the
shard where most of their weight is, if it gains by that. Proposals between two shards are admitted against each
other, the largest gains first, and against documents without neighbours, which move at no cost, so that shards keep
their sizes while linked documents gather. A final step makes the sizes exact by moving the fewest documents, those
without neighbours in their shard first. The driver sees sums by shard, target and gain, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stored

GAINS = 7  # gains from 2**6 on count as one level
BUCKET_ROWS = 20_000
SPREAD = (1 << 24, 1 << 16, 1 << 8, 1)


def unit(column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 40)) / F.lit(1 << 40)


def ranked(rows: DataFrame, key: str, level: Column, total: int, store: Stored) -> DataFrame:
    """`rows` with `rank`, gapless from 0 within `key`, by level and then in an order that a hash of `v` fixes.

    Rows are numbered in buckets of some BUCKET_ROWS rows, which get the sums of the buckets before them, so no task
    sorts a whole key.
    """
    buckets = total // BUCKET_ROWS + 1
    cut = store.put(rows.withColumn("_level", level).withColumn("_bucket", F.pmod(F.xxhash64("v", F.lit(11)), F.lit(buckets))))
    by = [key, "_level", "_bucket"]
    before = Window.partitionBy(key).orderBy("_level", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by).count().select(*by, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("v"))
    return (cut.withColumn("_number", number).join(offsets, by)
            .withColumn("rank", F.col("_offset") + F.col("_number") - 1).drop("_level", "_bucket", "_number", "_offset"))


def links_of_groups(members: DataFrame, store: Stored) -> DataFrame:
    """(a, b, weight) from (v, g): documents of equal g as a tree of bounded degree instead of all their pairs.

    Members meet in buckets of their group by a hash, each bucket's smallest member goes on to the next, coarser
    level; a link weighs as much as the documents it connects. Null groups have no links.
    """
    shared = members.where("g is not null").groupBy("g").count().where("count > 1").select("g")
    level = store.put(members.join(shared, "g", "left_semi").select("g", "v", F.lit(1).cast("long").alias("weight")))
    found = None
    for buckets in SPREAD:
        own = Window.partitionBy("g", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(buckets)))
        met = level.select("g", "v", "weight", F.min("v").over(own).alias("hub"), F.sum("weight").over(own).alias("all"))
        met = store.put(met)
        edges = met.where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b"), "weight")
        found = edges if found is None else found.union(edges)
        level = met.where("v = hub").select("g", "v", F.col("all").alias("weight"))
    return found


def admitted(proposals: dict[tuple[int, int, int], int], free: dict[int, int]) -> tuple[dict, dict]:
    """How many of the proposals (from, to, gain level) to admit, and of the free documents (from, to), without changing sizes."""
    pairs: dict[tuple[int, int], int] = {}
    for (a, b, _), n in proposals.items():
        pairs[a, b] = pairs.get((a, b), 0) + n
    moves, fill, left = {}, {}, dict(free)
    for a, b in sorted(pairs, key=lambda p: (pairs.get((p[1], p[0]), 0) - pairs[p], p)):
        back = pairs.get((b, a), 0)
        extra = min(max(0, pairs[a, b] - back), left.get(b, 0))
        moves[a, b] = min(pairs[a, b], back) + extra
        if extra:
            fill[b, a] = extra
            left[b] -= extra
    return moves, fill


def chance(moves: dict, proposals: dict) -> list[tuple[int, int, int, float]]:
    """(from, to, level, share to admit): whole levels from the greatest gain down, then a part of one."""
    out, left = [], dict(moves)
    for (a, b, level), n in sorted(proposals.items(), key=lambda x: -x[0][2]):
        taken = min(n, left[a, b])
        left[a, b] -= taken
        out.append((a, b, level, taken / n))
    return out


def balanced_shards(vertices: DataFrame, edges: DataFrame, shards: int, *, rounds: int = 8) -> DataFrame:
    """(v, shard) for every distinct `v` of `vertices`; counts of shards differ by one at most.

    `edges` has (a, b, weight); loops and edges to what is no vertex count for nothing. Rounds end early when nobody
    moves. With no edges the result is a balanced spread by hash; with no vertices it is empty.
    """
    spark, store = vertices.sparkSession, Stored(vertices.sparkSession, "shards")
    both = edges.where("a <> b").select("a", "b", "weight")
    both = store.put(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    linked = both.groupBy(F.col("a").alias("v")).agg((F.min("b") > F.col("v")).alias("first"))
    labels = store.put(vertices.select("v").join(linked, "v", "left").select(
        "v", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), "first"))
    total = labels.count()

    def votes(now: DataFrame) -> DataFrame:
        """(v, own, best): weight of neighbours in the own shard, and the (weight, shard) with most of it."""
        near = now.where("first is not null").select(F.col("v").alias("b"), F.col("shard").alias("theirs"))
        sums = both.join(near, "b").groupBy(F.col("a").alias("v"), "theirs").agg(F.sum("weight").alias("weight"))
        return sums.groupBy("v").agg(F.max(F.struct("weight", F.col("theirs").alias("shard"))).alias("best"),
                                     F.map_from_entries(F.collect_list(F.struct("theirs", "weight"))).alias("weights"))

    for turn in range(rounds):
        wish = labels.where("first is not null").join(votes(labels), "v").select(
            "v", "shard", F.col("best.shard").alias("target"), "first",
            (F.col("best.weight") - F.coalesce(F.element_at("weights", F.col("shard")), F.lit(0))).alias("gain"))
        # the smallest of a neighbourhood waits for the others; later a coin lets it move as well
        wish = store.put(wish.where((F.col("gain") > 0) & (~F.col("first") | (unit(F.col("v"), turn) < (0.0 if turn < 3 else 0.5))))
                         .withColumn("level", F.least(F.floor(F.log2("gain")), F.lit(GAINS - 1)).cast("int")))
        proposals = {(r.shard, r.target, r.level): r["count"] for r in wish.groupBy("shard", "target", "level").count().collect()}
        if not proposals:
            break
        free = {r.shard: r["count"] for r in labels.where("first is null").groupBy("shard").count().collect()}
        moves, fill = admitted(proposals, free)
        shares = spark.createDataFrame(chance(moves, proposals), "shard int, target int, level int, share double")
        go = wish.join(F.broadcast(shares), ["shard", "target", "level"]).where(unit(F.col("v"), 100 + turn) < F.col("share")).select("v", "target")
        lanes: dict[int, list[tuple[float, int]]] = {}
        for (a, b), n in sorted(fill.items()):
            steps = lanes.setdefault(a, [])
            steps.append(((steps[-1][0] if steps else 0.0) + n / free[a], b))
        to = F.lit(None).cast("int")
        for a, steps in lanes.items():
            for high, b in reversed(steps):
                to = F.when((F.col("shard") == a) & (F.col("_u") < high), b).otherwise(to)
        after = labels.join(go, "v", "left").withColumn("_u", unit(F.col("v"), 200 + turn)).select(
            "v", F.coalesce("target", F.when(F.col("first").isNull(), to), "shard").alias("shard"), "first")
        new = store.put(after)
        store.drop(labels)
        labels = new

    counts = {r.shard: r["count"] for r in labels.groupBy("shard").count().collect()}
    order = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    over = {s: counts.get(s, 0) - (total // shards + (k < total % shards)) for k, s in enumerate(order)}
    first, starts = 0, {}
    for s in order:
        if over[s] > 0:
            starts[s] = first
            first += over[s]
    if not first:
        return labels.select("v", "shard")
    gone, dest = F.lit(None).cast("int"), 0
    for s in order:
        if over[s] < 0:
            gone = F.when((F.col("_g") >= dest) & (F.col("_g") < dest - over[s]), s).otherwise(gone)
            dest -= over[s]
    weight = F.coalesce(F.element_at("weights", F.col("shard")), F.lit(0))
    cost = F.when(F.col("first").isNull(), 0).otherwise(F.lit(1) + F.least(F.floor(F.log2(weight + 1)), F.lit(GAINS)).cast("int"))
    full = labels.where(F.col("shard").isin(list(starts))).join(votes(labels), "v", "left").withColumn("cost", cost).select("v", "shard", "cost")
    places = ranked(full, "shard", F.col("cost"), total, store)
    start, most = F.lit(0), F.lit(0)
    for s, at in starts.items():
        start, most = F.when(F.col("shard") == s, at).otherwise(start), F.when(F.col("shard") == s, over[s]).otherwise(most)
    leaving = places.where(F.col("rank") < most).withColumn("_g", F.col("rank") + start).select("v", gone.alias("dest"))
    return labels.join(leaving, "v", "left").select("v", F.coalesce("dest", "shard").alias("shard"))


def shard_documents(docs: DataFrame, *, keep: list[str], text: str = "text", shards: int = 16, rounds: int = 8) -> DataFrame:
    """The columns `keep` of docs with size, text_crc32, law (`rows`), shard, slot and grown_shard (null under this law).

    Documents of equal text are linked. size is the UTF-8 bytes plus one; a null text has no bytes, the checksum of
    nothing and no links. Repeated rows are documents of their own; an empty table stays empty. Slots are gapless from
    0 in each shard. Columns of docs named like a result must not be among `keep`.
    """
    store = Stored(docs.sparkSession, "documents")
    rows = store.put(docs.select(
        *[docs[c] for c in keep], F.monotonically_increasing_id().alias("v"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(docs[text]), F.lit(0)).cast("long").alias("text_crc32"), F.when(docs[text].isNotNull(), F.xxhash64(docs[text])).alias("g")))
    found = store.put(balanced_shards(rows.select("v"), links_of_groups(rows.select("v", "g"), store), shards, rounds=rounds))
    places = ranked(found, "shard", F.lit(0), found.count(), store)
    return rows.join(places, "v").select(*keep, "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").cast("long").alias("slot"),
                                         F.lit(None).cast("int").alias("grown_shard"))
