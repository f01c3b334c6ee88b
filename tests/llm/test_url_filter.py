import random

from pyspark.sql import functions as F

from codetrawl.llm import url_filter as uf
from codetrawl.llm.queries import URL_RULES
from codetrawl.llm.shared import Stored, connected_components


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1), (2, None), (7, 9), (7, 9)]
    pairs += [(2000, 2000 + rng.randrange(1, 400)) for _ in range(400)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r.node: r.component for r in connected_components(frame, Stored(spark, "test")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(frame.limit(0), Stored(spark, "test")).count() == 0


def verdicts(spark, pages, redirects=None, rules=URL_RULES):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    given = spark.createDataFrame(redirects, "url string, target string") if redirects else None
    return uf.url_verdicts(frame, rules, given)


def test_rules_hosts_and_paths(spark):
    pages = [
        (1, "http://WWW.Example.com/en/x?q#f", ""), (2, "https://a.example.com/en/", None), (3, "https://x.com", ""),
        (4, "http://y.net/es/1", ""), (5, "http://net/fr/", ""), (6, "http://y.net/en/1", ""), (7, "nothing", ""), (8, None, None),
        (9, "http://?a/b", ""), (10, "http://badexample.com/en/", ""), (11, "a://b://c/d", ""), (11, "a://b://c/d", ""), (None, "http://ü.net/es/é?x", ""),
    ]
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in verdicts(spark, pages).collect()), key=str)
    assert got == sorted([
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "x.com", "", None, "allow"), (4, "y.net", "/es/1", "net/es/", "block"), (5, "net", "/fr/", "net/fr/", "block"),
        (6, "y.net", "/en/1", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
        (10, "badexample.com", "/en/", "com/", "allow"), (11, "b:", "//c/d", None, "allow"), (11, "b:", "//c/d", None, "allow"),
        (0, "ü.net", "/es/é", "net/es/", "block")], key=str)


def test_decisions_reach_aliases(spark):
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow")]
    pages = [
        (1, "http://bad.org/a", ""), (2, "http://alias.org/1", '<link rel="canonical" href="https://www.bad.org/a/">'),
        (3, "http://hop.org/2", '<meta http-equiv="refresh" content="0; url=http://alias.org/1?utm_source=x">'),
        (4, "https://m.hop.org/2/#frag", ""), (5, "http://bad.org/b", ""), (6, "http://free.org/3", "<LINK href='//good.org/z' rel=canonical>"),
        (7, "http://bad.org/c", '<link rel="canonical" href="http://free.org/3">'), (8, "http://far.org/", ""), (9, "http://else.org/q?id=1", ""),
        (10, "http://far.org/next", '<link rel="canonical" href="/rel">'), (11, "http://far.org/rel", ""),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in verdicts(spark, pages, [("http://far.org", "http://bad.org/b"), (None, "x")], rules).collect()}
    assert [got[i][1] for i in range(1, 12)] == ["block", "block", "block", "block", "block", "allow", "block", "block", "allow", "allow", "allow"]
    assert verdicts(spark, pages).limit(0).count() == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert uf.url_verdicts(empty, rules).count() == 0
    assert uf.url_verdicts(empty.drop("html"), rules).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
