import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetrawl.llm import collocations as module
from codetrawl.llm import quotient_filter as qf
from codetrawl.llm.collocations import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inner = defaultdict(int)
        for g, a in often.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    inner[g[i:i + size]] = max(inner[g[i:i + size]], a)
        scored = []
        for g, a in often.items():
            if g in inner and 100 * inner[g] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def as_rows(frame):
    rows = [tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 1 << 21), (700, 900)])
def test_equal_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(module, "BLOCK_TOKENS", block)  # many blocks and shards in the second run
    monkeypatch.setattr(module, "SHARD_TOKENS", shard)
    rng = random.Random(3)
    fixed = ["New York", "in the  house of", "Ägypten\tund", "to be or not", "a a a a a", "x\x01 y", "x y"]
    rows = []
    for k in range(200):
        words = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice("the of and a b c d é Straße".split()) + rng.choice(["", "", ".", "!\n"]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), " ".join(words)))
    rows += [("de", None), ("de", ""), (None, " \t ,,"), ("en", rows[0][1])]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumn("n", F.lit(1)).withColumn("block", F.lit("x"))
    for least, top in ((10, 2000), (3, 40)):
        assert as_rows(collocations(docs, least=least, top=top)) == plain(rows, least, top)


def test_vocabulary_never_goes_through_the_driver(spark):
    docs = spark.createDataFrame([("en", "in the house of cards")] * 40, "lang string, text string")
    found = collocations(docs)
    assert found.count() > 0
    # the number of all words of each language alone is sent to all tasks
    assert found._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
    long = "bigint"
    rows = spark.createDataFrame([(1, 0, 0, 1, 2, 0, 0)], ", ".join(f"{c} {long}" for c in ("x1", "x2", "x3", "w1", "w2", "w3", "w4")))
    parts = spark.createDataFrame([(1, 0, 0, 7, s) for s in range(module.SPREAD)], "p1 bigint, p2 bigint, p3 bigint, f bigint, salt int")
    looked = module._looked_up(rows, parts, "x", "l")
    assert "Broadcast" not in looked._jdf.queryExecution().sparkPlan().toString() and [r.l for r in looked.collect()] == [7]


def test_no_rows(spark):
    docs = spark.createDataFrame([("en", "just a few words"), ("en", None)], "lang string, text string")
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0


def test_long_text_without_ends(spark):
    text = "alpha beta gamma " * 200_000  # cut between words, not between pieces
    docs = spark.createDataFrame([("en", text), ("en", "alpha beta")], "lang string, text string")
    assert as_rows(collocations(docs)) == plain([("en", text), ("en", "alpha beta")], 30, 2000)


def test_segments_lose_nothing(monkeypatch):
    monkeypatch.setattr(module, "SEGMENT_BYTES", 10)
    for data in (b"", b"aaaa bbbb cccc. dddd eeee ffff gggg hhhh iiii", b"a" * 95 + b" b" * 30, b"a" * 200):
        assert b"".join(module.segments(data)) == data


def test_permutation_and_filters_come_back():
    rng = np.random.default_rng(5)
    for size, bits in ((2, 1), (2, 9), (3, 4), (3, 31), (4, 17), (4, 31)):
        words = [rng.integers(0, 1 << bits, size=3000) for _ in range(size)]
        wide = qf.widths(size, bits)
        left, right = qf.permuted(*qf.packed(words, bits), wide)
        back = qf.unpacked(*qf.restored(left, right, wide), size, bits)
        assert all((a == b).all() for a, b in zip(words, back))
        shard_bits = min(bits, 3)
        left, right, counts, entry = qf.distinct(left, right, rng.integers(1, 600, size=3000))
        assert entry.max() + 1 == len(left)
        for shard in range(1 << shard_bits):
            own = np.flatnonzero(left >> np.uint64(wide[0] - shard_bits) == shard)
            data = qf.encoded(left[own], right[own], counts[own], shard, shard_bits, wide)
            for a, b in zip(qf.decoded(data), (left[own], right[own], counts[own])):
                assert (a == b).all()


def test_score_beyond_64_bits(spark):
    a = 9 * 10**15
    row = spark.range(1).select(F.lit(a).cast("long").alias("f"), F.lit(a).cast("long").alias("l"), F.lit(a).cast("long").alias("r"))
    assert row.select(F.expr("(cast(f as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")).first()[0] == 10**6


def test_pairs_are_sorted_once(monkeypatch):
    """One sort by 64 bits will do for pairs of two numbers and for spread entries; pairs that differ behind them come out right, too."""
    rng = np.random.default_rng(5)
    both, used = np.lexsort, []
    monkeypatch.setattr(np, "lexsort", lambda keys: used.append(1) or both(keys))
    for left_bits, right_bits, again in ((20, 20, False), (40, 40, False), (60, 63, True), (64, 20, True), (64, 0, False), (0, 64, False)):
        pool = [rng.integers(0, 2**bits - 1, 400, dtype=np.uint64, endpoint=True) if bits else np.zeros(400, np.uint64) for bits in (left_bits, right_bits)]
        if again:
            pool[0][:] = pool[0][0] | np.uint64(1 << left_bits - 1)
        at, counts = rng.integers(0, 400, 3000), rng.integers(1, 9, 3000)
        left, right = pool[0][at], pool[1][at]
        used.clear()
        a, b, sums, entry = qf.distinct(left, right, counts)
        expected = Counter()
        for pair, n in zip(zip(left.tolist(), right.tolist()), counts.tolist()):
            expected[pair] += n
        assert list(zip(a.tolist(), b.tolist(), sums.tolist())) == [(*pair, n) for pair, n in sorted(expected.items())]
        assert (a[entry] == left).all() and (b[entry] == right).all()
        assert again or not used
