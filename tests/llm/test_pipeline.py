import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_decontaminate import plain as plain_hits
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append((docs, path := str(tmp_path_factory.mktemp(name) / "out")))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [(before.collect(), spark.read.parquet(path)) for before, path in out]


def test_all_but_the_last_return_the_columns_of_documents(stages, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [s[1].columns == columns for s in stages] == [True] * 4 + [False]
    assert len(cp.STAGES) == 5


def test_language_keeps_prose(stages):
    before, after = stages[0]
    left = {r.doc_id for r in after.collect()}
    assert len(left) >= 0.97 * len(before)


def test_site_lines_equal_brute_force(stages):
    before, after = stages[1]
    distinct = {(r.source, r.text) for r in before}  # copies on a site are one page of it
    pages, found = Counter(source for source, _ in distinct), Counter()
    for source, text in distinct:
        found.update({(source, x.strip(" \t\r\x0b\x0c")) for x in text.split("\n")})
    gone = {k for k, n in found.items() if k[1] and n >= 3 and n > 0.05 * pages[k[0]]}
    expected = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r\x0b\x0c")) not in gone) for r in before}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copies_equal_brute_force(stages):
    before, after = stages[2]
    kept = plain_kept([r.doc_id for r in before], [r.text for r in before])
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept)


def test_leaks_equal_brute_force(stages, spark):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {int(r[0]) for r in plain_hits([(r.doc_id, r.text) for r in before], items) if r[4]}
    assert hit and {r.doc_id for r in after.collect()} == {r.doc_id for r in before} - hit


def test_pieces_hold_all_that_is_left(stages):
    before, after = stages[4]
    pieces = after.collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before}
    for doc, total in {p.doc_id: p.doc_tokens for p in pieces}.items():
        assert sum(p.length for p in pieces if p.doc_id == doc) == total


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "xx", "a", 0), (2, "the words of this " * 30, "en", None, 9),
            (2, "the words of this " * 30, "en", None, 9), (3, "der die das und " * 30, "de", "b", 9), (4, "1 2 3", "de", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("zz"))
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.read.parquet(path)
    assert sorted({r.doc_id for r in docs.collect()}) == [2, 3]
    assert json.dumps(cp.ORACLE_SQL) == "null"


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
