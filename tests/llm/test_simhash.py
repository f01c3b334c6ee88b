import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from codetrawl.llm import simhash


def plain_fingerprint(text, size=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", simhash_lower(text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def simhash_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_components(ids, prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in zip(ids, prints):
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [least.get(root(f)) for f in prints]


def test_fingerprints_of_odd_texts(spark):
    texts = ["", None, "one", "Two words", "A b C\td\n\ne  f", "Ünï çödé ÀÉ x " * 30, "x" * 5000, " \t\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint & (2**64 - 1) for r in simhash.with_fingerprint(frame).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    prints, hub = [], rng.getrandbits(64)
    for _ in range(120):
        prints.append(rng.getrandbits(64))
    for _ in range(150):  # near a hub: many share one cell
        prints.append(hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):  # a long chain of two-bit steps
        chain ^= 3 << b
        prints.append(chain)
    prints += prints[:40] + [0, 0]
    ids = list(range(1000, 1000 + len(prints)))
    rng.shuffle(ids)
    ids[3], ids[5] = None, ids[6]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fingerprint long")
    groups = {r.fp: r.component_id for r in simhash.near_groups(frame).collect()}
    assert [groups[s] for s in signed] == plain_components(ids, prints)


def test_near_duplicates_of_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(7, base, "x"), (3, base, "y"), (None, base, "z"), (9, "other text entirely", None), (1, None, None), (2, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).orderBy(F.col("doc_id")).collect()]
    assert got == [(None, 3), (1, 1), (2, 1), (3, 3), (7, 3), (9, 9)]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_cells_with_company_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(60), k) for k in range(90)] + [(7, 1000 + k) for k in range(20)]
    held = {}
    for cell, fp in rows:
        held.setdefault(cell, []).append((cell, fp))
    expected = sorted(r for own in held.values() if len(own) > 1 for r in own)
    frame = spark.createDataFrame(rows, "cell long, fp long")
    for size in (1, 2, 3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(map(tuple, simhash.in_company(frame).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == expected


def test_links_meet_in_a_shared_cell(spark):
    rng = random.Random(6)
    hub = rng.getrandbits(64)
    prints = {hub} | {hub ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(30)}
    signed = [(p - 2**64 if p >> 63 else p,) for p in sorted(prints)]
    found = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert found and all((a ^ b).bit_count() in (1, 2) for a, b in found)
    ids = sorted(prints)
    parent = {f: f for f in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    names = plain_components(ids, ids)
    assert all((root(a) == root(b)) == (names[i] == names[j]) for i, a in enumerate(ids) for j, b in enumerate(ids))
