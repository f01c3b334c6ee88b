import hashlib
import random
from collections import Counter

import pytest

from codetrawl.llm import suffix_dedup as sd
from codetrawl.llm.suffix_groups import suffix_array


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(500):
        kinds, size = rng.choice([1, 2, 2, 3, 5, 50]), rng.randrange(60)
        text = [rng.randrange(kinds) for _ in range(size)] * rng.choice([1, 1, 3])
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["ünï", "日本"]

    def say(n):
        return "".join(rng.choice(vocabulary) + rng.choice("  \n") for _ in range(n))

    passages = [say(rng.choice([90, 110, 150, 300])) for _ in range(8)]
    texts = [say(rng.randrange(0, 300)) for _ in range(30)]
    for _ in range(60):
        p = rng.choice(passages)
        i = rng.randrange(0, len(p) // 2)
        texts.append(say(rng.randrange(60)) + p[i:] + say(rng.randrange(60)) + (rng.choice(passages) if rng.random() < 0.3 else ""))
    for _ in range(20):  # near copies: one word changed
        words = texts[rng.randrange(30)].split(" ")
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "a" * 399, "a" * 400, "b" * 401, "cd" * 600, "tail " + "cd" * 300, texts[5] * 2]
    return texts + texts[10:14] + [texts[12]] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.without_repeats(frame, keep=["doc_id"], digest=True).collect()}
    expected = dict(enumerate(plain(texts, 400)))
    assert {k for k in expected if got.get(k) != expected[k]} == set()


def test_strings_of_contexts():
    rng = random.Random(9)
    base = bytes(rng.randrange(97, 101) for _ in range(900))
    contexts = [base[:700], base[100:], base[300:650] + b"zz" + base[652:], b"x" * 500, base[:90] + base[450:880], b"y" * 399]
    count = Counter(c[i:i + 400] for c in contexts for i in range(len(c) - 399))
    for c, flags in zip(contexts, sd.repeated_strings(contexts, 400)):
        assert flags.tolist() == [count[c[i:i + 400]] > 1 for i in range(max(0, len(c) - 399))]


def test_real_bytes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE_BYTES", 1000)
    texts = [b.decode() for b in (b"q" * 100 + bytes(range(97, 123)) * 200, b"0123456789" * 300)]
    runs = sd.anchor_runs([t.encode() for t in texts], 400, sd.Rolling(21), sd.Rolling(22))
    for k, t in enumerate(texts):
        mine = sorted((int(lo), int(hi)) for w, lo, hi in zip(*runs[:3]) if w == k)
        assert mine[0][0] == 0 and mine[-1][1] == len(t) - 400 and all(a[1] + 1 == b[0] for a, b in zip(mine, mine[1:]))
    frame = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, bytes(r.kept)) for r in sd.without_repeats(frame, keep=["doc_id"]).collect()) == [(0, b""), (9, b"some text")]
    assert sd.without_repeats(frame.limit(0), keep=["doc_id"]).count() == 0
