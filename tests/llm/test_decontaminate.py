import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codetrawl.llm.decontaminate import contamination


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        found = sorted(str(f) for f in found if f is not None)
        out.append((str(doc), len(w), len(hit), found, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünï", "x1", "naïve", "Q", "9", "çà", "or", "and"] + [f"w{i}" for i in range(6)]
    def say(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "' "]) for _ in range(n))
    items = [(i, say(rng.choice([2, 3, 5, 9, 10, 11, 30]))) for i in range(12)] + [(3, "of of of of"), (None, "zz yy xx ww vv"), (50, ""), (51, None), (52, "!!")]
    items += [(60, items[5][1]), (61, items[5][1])]
    docs = [(i, say(rng.randrange(0, 200))) for i in range(40)]
    docs += [(100 + i, say(20) + t.upper() + say(20)) for i, (_, t) in enumerate(items) if t]
    docs += [(None, "zz yy xx ww vv"), (7, None), (7, ""), (7, say(5)), (8, "zz  YY\txx ww (vv) " * 3)]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, window string, token long")
    b = spark.createDataFrame([(a, b, "y") for a, b in items], "item_id long, text string, doc_id string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated)
                 for r in contamination(d.repartition(3), b, keep=["doc_id"]).collect())
    assert got == plain(docs, items)


def test_empty_tables_and_long_text(spark):
    d = spark.createDataFrame([(1, "some words " * 400000 + "one two three four five six seven eight nine ten")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    row = contamination(d, b, keep=["doc_id"]).collect()[0]
    assert (row.n_words, row.n_hit, row["items"]) == (800010, 10, ["1"])
    none = contamination(d, b.limit(0), keep=["doc_id"]).collect()[0]
    assert (none.n_hit, none["items"], none.n_items) == (0, [], 0)
    assert contamination(d.limit(0), b, keep=["doc_id"]).count() == 0
    assert hashlib.sha256(b"").hexdigest() == d.select(F.sha2(F.lit(""), 256)).first()[0]


def test_blocks_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from codetrawl.llm import decontaminate as module
    from codetrawl.llm.shared import Rolling, Words, text_batches

    rows = pa.RecordBatch.from_pydict({"text": ["some words of a text " * 150] * 1500})
    tracemalloc.start()
    rolling, most = Rolling(), 0
    for _, block in text_batches(rows, "text", module.BLOCK_BYTES):
        Words(rolling, block).shingles(5)
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert most < 32e6
