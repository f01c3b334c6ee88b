import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from codetrawl.llm import spelling
from codetrawl.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_counts(rows, every=31):
    out = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 7:
                out[word] += 1
    return out


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    words = {w: n for w, n in counts.items() if n >= 2}
    by_part = defaultdict(set)  # near words share a half, or a half with one code point less or more
    for w in words:
        for size in range(len(w) - 1, len(w) + 2):
            by_part[size, "head", w[:size // 2 - 1]].add(w)
            by_part[size, "tail", w[len(w) - (size // 2 - 1):]].add(w)
    near = {w: {v for size in range(len(w) - 1, len(w) + 2) for k in (("head", w[:size // 2 - 1]), ("tail", w[len(w) - (size // 2 - 1):]))
                for v in by_part[size, *k] if is_near(w, v)} for w in words}
    form = {}
    for w, all_near in near.items():
        if all_near:
            best = min(all_near, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return out


def as_rows(frame):
    rows = [tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = plain_variants(plain_counts([(r.doc_id, r.text) for r in docs]))
    found = as_rows(QUERIES["op11_spelling"](spark, SF))
    assert found == expected and any(r[3] for r in found)


def test_few_letters_many_ranges(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choice("abä") for _ in range(rng.randrange(7, 10))): rng.choice([1, 2, 3, 25, 300, 4000]) for _ in range(1500)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert as_rows(spelling.spelling_variants(frame)) == plain_variants(counts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_chains_of_forms(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    counts = {w: 2 * 10 ** k for k, w in enumerate(chain)} | {"zzzzzzz": 1, "abcdefgx": 2}
    found = {r[0]: r for r in as_rows(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert [found[w][5] for w in chain] == [chain[-1]] * 5
    assert found["abcdefgh"][2] == 2 and found["abcdefgh"][3] == "abcdefghi" and found[chain[-1]][3] is None
    assert found["abcdefgx"][3] is None and "zzzzzzz" not in found  # the near word occurs no more often; one occurrence


def test_odd_rows(spark):
    long_word = "loremü" * 20_000
    rows = [(None, None, 1), (1, None, 1), (2, "", 1), (3, "short 1234567 !!!", 1), (None, "ABCDEFG abcdefg", 1),
            (5, "ABCDEFG ÉCOLIER écolier", 1), (5, "ABCDEFG ÉCOLIER écolier", 1), (6, long_word + " " + long_word + "x " + long_word + "x", 1), (6, long_word, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long")
    counts = {r.word: r.n for r in spelling.word_counts(docs, typo_every=31).collect()}
    assert counts == plain_counts([(r[0], r[1]) for r in rows])
    found = {r[0]: r for r in as_rows(spelling.spelling_variants(spelling.word_counts(docs)))}
    assert set(found) == {"abcdefg", "Écolier", "écolier", long_word, long_word + "x"}
    assert found[long_word][2] == 1 and found["Écolier"][2] == 1  # only A to Z are lower-cased
    empty = docs.limit(0)
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0
    assert spelling.word_counts(docs.withColumn("n", F.lit("x"))).count() == len(plain_counts([(r[0], r[1]) for r in rows], every=None))
