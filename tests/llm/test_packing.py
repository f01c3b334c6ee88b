import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codetrawl.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")  # the same vocabulary for the other library, whose ids count


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(4)
    odd = "ab Z0'’—\n\t  é.,!sredvml\x0b\x1c²½ºª_日 ǆ"
    out = ["".join(rng.choice(odd) for _ in range(rng.randrange(80))) for _ in range(150)]
    out += [" ".join(rng.choice(["alpha", "beta", "Straße", "42", "don't", "<|endoftext|>"]) for _ in range(rng.randrange(1500))) for _ in range(60)]
    return out + ["", None, "x " * 20000, "same", "same"]


def test_encoder_equals_tokenizer(tokenizer):
    encoder = packing.Encoder(PATH, remembered=50)
    for first in range(0, len(texts()), 7):
        part = [t or "" for t in texts()[first:first + 7]]
        expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in part]
        assert encoder.ids(part) == expected


def test_pieces_cover_documents_and_fill_sequences(spark, tokenizer, monkeypatch):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "id again")]
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int").repartition(2)
    pieces = packing.pack(frame, PATH).collect()
    expected = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected.setdefault(i, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(expected)
    for i, own in by_doc.items():
        docs = expected[i]
        assert sum(p.length for p in own) == sum(map(len, docs))
        if len(docs) > 1:
            continue
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            ids = np.array(docs[0][p.start:p.start + p.length], dtype="<u4").tobytes()
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(ids), len(docs[0]))
            at += p.length
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == own[0].sequence_length <= 2048 and at & (at - 1) == 0


def test_blocks_keep_tails(monkeypatch):
    rng = random.Random(1)
    docs = [(k, 0, rng.choice([1, 5, 100, 700, 1500, 2047, 2048, 5000])) for k in range(200)]
    found, rest = packing.packed(docs, 2048, 128, last=False)
    assert all(sum(p[2] for p in s) in (128, 256, 512, 1024, 2048) for s in found) and sum(p[2] for p in rest) < 2048
    found, rest = packing.packed(docs, 2048, 128, last=True)
    ids = [(d, t) for s in found for d, start, length in s for t in range(start, start + length)]
    assert not rest and len(ids) == len(set(ids)) == sum(d[2] for d in docs)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_added_tokens_are_those_of_the_json():
    plain = Tokenizer.from_file(JSON)  # no setting changed
    encoder = packing.Encoder(PATH, added=JSON)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  ", "x \n<|endoftext|>\n y", "<|endoftext|", "<|ENDOFTEXT|>", "日<|endoftext|>本 "]
    part = [*odd, *(t or "" for t in texts())]
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in encoder.ids(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]
    assert np.frombuffer(encoder.ids(odd[:1])[0], dtype="<u4").tolist() == [64, 220, 50256, 275]


def test_query_packs_added_tokens(spark, tmp_path):
    from codetrawl.llm.queries import op7_packing

    spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op7_packing(spark, str(tmp_path)).collect()
    ids = np.array([64, 220, 50256, 275, 1], dtype="<u4")
    assert {r.doc_tokens for r in rows} == {5} and sum(r.length for r in rows) == 5
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in rows)


def test_tiers_have_windows_of_their_own():
    rng = random.Random(2)
    lengths = [rng.randrange(low, 2 * low) for low, n in ((64, 3000), (129, 1500), (257, 500), (513, 200), (1025, 60)) for _ in range(n)]
    docs = [(k, 0, min(length, 2047)) for k, length in enumerate(lengths)]
    rng.shuffle(docs)
    found, _ = packing.packed(docs, 2048, 128, last=False)
    sizes = {}
    for window in found:
        size = sum(p[2] for p in window)
        sizes[size] = sizes.get(size, 0) + 1
        # a document of the tier opens the window, shorter ones follow, longest fit first, then at most one head
        assert size / 2 < window[0][2] <= size or size == 128
        whole = window[1:-1]
        assert [p[2] for p in whole] == sorted((p[2] for p in whole), reverse=True)
    assert set(sizes) == {128, 256, 512, 1024, 2048}
    long = [w for w in found if sum(p[2] for p in w) == 2048]
    assert sum(len(w) > 1 and w[1][2] <= 1024 for w in long) > len(long) / 2


def test_step_groups_equal_plain_dealing(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([(k, "word " * rng.choice([3, 60, 300, 1500, 2047, 4095])) for k in range(700)], "doc_id long, text string").repartition(3)
    pieces = packing.pack(frame, PATH, per_step=2).collect()
    windows = {}
    for p in pieces:
        windows.setdefault((p.sequence_length, p.sequence_id), []).append(p)
    assert all({p.sequence_cost for p in own} == {sum(p.length ** 2 for p in own)} and len({p.step_group for p in own}) == 1 for own in windows.values())
    for size in {s for s, _ in windows}:
        order = sorted((-own[0].sequence_cost, key[1], own[0].step_group) for key, own in windows.items() if key[0] == size)
        steps = max(1, len(order) * size // (2 * 2048))
        for rank, (_, _, group) in enumerate(order):
            turn, at = divmod(rank, steps)
            assert group == (size << 40) + (steps - 1 - at if turn % 2 else at)
    assert len({p.step_group for p in pieces}) > 20
