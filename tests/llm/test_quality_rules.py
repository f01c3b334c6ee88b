import random
import re
from collections import Counter

from codetrawl.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


def texts():
    rng = random.Random(3)
    out = ["", None, " \n\t", "a", "Ünï | çödé\x1c\x85x y " * 20, "same line\n" * 40, "BIG WORDS " * 40, "#x %y " * 60]
    for _ in range(60):
        pool = [f"wörd{i}" for i in range(rng.randrange(2, 300))] + ["|", "The", "9"]
        out.append("".join(rng.choice(pool) + rng.choice(" \n\t ") for _ in range(rng.randrange(200))))
    return out + [out[-1], " ".join(f"word{i}" for i in range(150000))]


def test_counts_and_order(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, kept string")
    first = q.judge(frame, keep=["doc_id"]).collect()
    for r in first:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts()[r.doc_id])
        page = q.Page((texts()[r.doc_id] or "").encode())
        assert r.kept == (not r.base_failed and not any(rule(page) for rule in q.RULES.values()))
    for order in (list(q.RULES), list(q.RULES)[::-1]):
        assert {(r.doc_id, r.kept) for r in q.judge(frame, keep=["doc_id"], order=order).collect()} == {(r.doc_id, r.kept) for r in first}
    assert sorted(q.measured_order(frame, "text", q.RULES, 1000)) == sorted(q.RULES)
    assert q.judge(frame.limit(0), keep=["doc_id"]).count() == 0


def test_cheap_and_selective_rules_come_first(spark):
    import time
    frame = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)], "doc_id long, text string")

    def slow(page):
        time.sleep(0.002)
        return True

    rules = {"slow": slow, "never": lambda p: False, "always": lambda p: True}
    assert q.measured_order(frame, "text", rules, 1000)[0] == "always"
    assert {r.rejected_by for r in q.judge(frame, keep=["doc_id"], rules=rules).collect()} == {"always"}
