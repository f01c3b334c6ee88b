import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetrawl.llm import language_id as lid


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Ünï 12 çödé -- ÀÉß the 日本  words, " * 300
    whole = lid.gram_counts(text)
    monkeypatch.setattr(lid, "BLOCK_CHARS", 101)
    assert np.array_equal(whole, lid.gram_counts(text))
    assert lid.gram_counts("12 -- !") is None and lid.gram_counts("") is None and lid.gram_counts("x") is not None


def test_leader_learns_sparse_weights():
    rng = np.random.default_rng(1)
    leader = lid.Leader(np.zeros((50, 2)), np.zeros((50, 2)))
    for _ in range(600):
        label = int(rng.integers(2))
        x = np.zeros(50)
        x[label] = 1.0
        x[10 + rng.integers(30)] = 0.3
        leader.learn(x, label)
    w = leader.weights()
    assert w[0, 0] > 1 > w[0, 1] and w[1, 1] > 1 > w[1, 0]
    assert (w == 0).mean() > 0.3 and not w[45:].any()


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(None, None, "fr"), (-1, "", "de"), (-2, "12 !", None), (-3, "der die das " * 4000, None), (-4, "der die das " * 4000, "en")]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    docs = docs.withColumn("score", F.lit("clash"))
    return docs.drop("score"), lid.predict(docs, lid.train(docs, per_language=200), keep=["doc_id", "lang", "text"]).collect()


def test_held_out_accuracy(predicted):
    rows = [r for r in predicted[1] if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [r.lang_pred == r.lang for r in rows]
    assert len(rows) > 100 and np.mean(right) >= 0.95
    gap = abs(np.mean([r.score for r in rows]) - np.mean(right))
    assert gap < 0.05


def test_odd_texts(predicted):
    odd = {r.doc_id: (r.lang_pred, r.score) for r in predicted[1] if r.doc_id is None or r.doc_id < 0}
    assert odd[None] == odd[-1] == odd[-2] == ("und", 0.0)
    assert odd[-3] == odd[-4] and odd[-3][0] == "de"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert lid.train(docs) is None
    assert {(r.lang_pred, r.score) for r in lid.predict(docs, None).collect()} == {("und", 0.0)}
    assert lid.predict(docs.limit(0), None).count() == 0


def test_texts_go_to_python_once(spark):
    """Neither the other columns nor a second copy of the text are sent, and one judgement serves several conditions."""
    docs = spark.createDataFrame([(k, "der die das und", "de", {"k": "v"}) for k in range(50)], "doc_id long, text string, lang string, more map<string,string>")
    model = lid.Model(["de", "en"], np.ones(lid.SIZE, dtype=np.float32), np.zeros((lid.SIZE, 2), dtype=np.float32))
    judged = lid.predict(docs, model)
    assert judged.columns == [*docs.columns, "lang_pred", "score"]
    assert {(r.text, r.lang_pred, r.score, r.more["k"]) for r in judged.collect()} == {("der die das und", "de", 0.5, "v")}
    chosen = judged.where((F.col("lang_pred") != lid.UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [run(") == 1 and plan.count("run(") == 1, plan
    assert chosen.count() == 50
