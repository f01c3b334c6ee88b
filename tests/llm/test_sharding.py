import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from codetrawl.llm import sharding


def check(rows, texts, shards):
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in counts)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        data = (texts[r.k] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_groups_gather_in_even_shards(spark):
    rng = random.Random(2)
    texts = [f"alone {i}" for i in range(900)] + ["hot ü"] * 500 + [None, "", ""]
    for g in range(120):
        texts += [f"group {g}"] * rng.choice([2, 2, 3, 5, 12])
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k long, text string, shard string").repartition(3)
    rows = sharding.shard_documents(frame, keep=["k"], shards=8).collect()
    assert sorted(r.k for r in rows) == list(range(len(texts)))
    check(rows, texts, 8)
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.k], []).append(r.shard)
    small = [v for t, v in by_text.items() if t and t.startswith("group")]
    whole = sum(len(set(v)) == 1 for v in small)
    assert whole >= 0.9 * len(small)
    hot = Counter(by_text["hot ü"])
    assert sum(n for _, n in hot.most_common(2)) >= 0.6 * len(texts) / 8 * 2 * 0.5 and max(hot.values()) > 500 / 8


def test_trees_connect_groups_with_few_links_each(spark):
    members = spark.range(3000).select(F.col("id").alias("v"), F.when(F.col("id") < 2000, 1).when(F.col("id") < 2990, F.col("id")).alias("g"))
    edges = sharding.links_of_groups(members, sharding.Stored(spark, "test")).collect()
    parent = list(range(2000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[root(e.a)] = root(e.b)
    assert len({root(x) for x in range(2000)}) == 1 and len(edges) == 1999
    assert max(Counter(x for e in edges for x in (e.a, e.b)).values()) <= 300


def test_admission_keeps_sizes():
    moves, fill = sharding.admitted({(0, 1, 2): 10, (1, 0, 1): 4, (2, 1, 0): 5}, {0: 3, 1: 8, 2: 1})
    change = Counter()
    for (a, b), n in [*moves.items(), *fill.items()]:
        change[a] -= n
        change[b] += n
    assert not any(change.values()) and moves[0, 1] == 10


def test_odd_inputs(spark):
    frame = spark.createDataFrame([(None, None), (1, "same"), (1, "same"), (2, "")], "k long, text string")
    assert len(sharding.shard_documents(frame, keep=["k"]).collect()) == 4
    assert sharding.shard_documents(frame.limit(0), keep=["k"]).count() == 0
