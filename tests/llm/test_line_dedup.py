import random
from collections import Counter

from codetrawl.llm.line_dedup import drop_site_lines

BLANKS = " \t\r\x0b\x0c"


def plain(rows, ratio, least):
    pages, found = Counter(), Counter()
    for _, host, text in rows:
        pages[host or ""] += 1
        found.update({(host or "", x.strip(BLANKS)) for x in (text or "").split("\n") if text is not None} - {(host or "", "")})
    gone = {k for k, n in found.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host or "", x.strip(BLANKS)) not in gone]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    common = ["Home | About", "  Share this ", "Share this\r", "©", "", " "]
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "a", "b", "c", None, ""])
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own {rng.randrange(2000)}" for _ in range(rng.randrange(12))]
        rows.append((i, host, "\n".join(lines)))
    rows += [(None, "a", None), (301, "d", "once\nonce\nonce"), (302, "a", "x\n" * 5000 + "Share this"), (303, "a", ""), (1, "a", "Home | About\n"), (1, "a", "Home | About\n")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, n_lines int").repartition(4)
    got = drop_site_lines(frame, ratio=0.1, min_pages=3)
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == plain(rows, 0.1, 3)
    assert drop_site_lines(frame.limit(0)).count() == 0


def test_copies_count_once_if_asked_for(spark):
    rows = [(i, "a", f"menu\nown {i}") for i in range(40)] + [(100 + i, "a", "menu\nfirst of the copy\nsecond of the copy") for i in range(20)]
    rows += [(200 + i, "b", "only text\nof its site") for i in range(5)] + [(300, "b", None), (301, "b", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_site_lines(frame, copies_once=True).collect()), key=str)
    distinct = {(host, text): i for i, host, text in rows}
    texts = {i: r for i, *r in plain([(i, *k) for k, i in distinct.items()], 0.05, 3)}
    assert got == sorted(((i, *texts[distinct[host, text]]) for i, host, text in rows), key=str)
    assert (100, "first of the copy\nsecond of the copy", 3, 1) in got and (200, "only text\nof its site", 2, 0) in got
