import numpy as np
from pyspark.sql import functions as F

from codetrawl.llm import quality_classifier as qc
from codetrawl.llm.shared import Rolling


def test_features_are_those_of_each_text():
    rolling = Rolling()
    texts = [b"a b a % %", b"", b"ABC abc x", b"a b a % %", "çà % ".encode() * 30]
    owners, hashes = qc.features(rolling, texts)
    assert list(owners) == sorted(owners)
    for k, text in enumerate(texts):
        alone = qc.features(rolling, [text])[1]
        assert sorted(hashes[owners == k]) == sorted(alone) and len(set(alone)) == len(alone)
    assert not (owners == 1).any()


def test_gradient_of_the_cumulative_link():
    thresholds, score, eps = np.array([-0.7, 0.9]), 0.3, 1e-6

    def loss(s, t, y):
        below = np.concatenate([[0], 1 / (1 + np.exp(s - t)), [1]])
        return -np.log(below[y + 1] - below[y])

    for y in range(3):
        fit = qc.Fit(thresholds.copy(), np.array([5], dtype=np.uint64), np.array([0.0]), np.array([0.0]))
        fit.weights = lambda at: np.array([score])
        fit.learn(np.array([0]), y)
        g = (loss(score + eps, thresholds, y) - loss(score - eps, thresholds, y)) / (2 * eps)
        assert abs(np.sqrt(fit.n[0]) - abs(g)) < 1e-4
        for k in range(2):
            moved = thresholds.copy()
            moved[k] += eps
            slope = (loss(score, moved, y) - loss(score, thresholds, y)) / eps
            assert abs((thresholds[k] - fit.thresholds[k]) / 0.02 - slope) < 1e-3


def test_held_out_grades(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("selected", F.lit("clash"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rated = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = qc.train(docs, rated.where(~held).union(spark.createDataFrame([(None, 2), (1, None), (1, 9)], "doc_id long, grade int")))
    assert (np.diff(model.thresholds) >= 0).all()
    rows = qc.grade(docs, model, keep=["doc_id"]).join(rated.where(held), "doc_id").collect()
    clean = [r.selected for r in rows if r.grade == 2]
    toxic = [r.selected for r in rows if r.grade == 0]
    assert np.mean(clean) > 0.97 and np.mean(toxic) < 0.15
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_nothing_rated_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 300000), (2, "")], "doc_id long, text string")
    model = qc.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    rows = qc.grade(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == 4 and len({r.expected_grade for r in rows}) == 1
    assert qc.grade(docs.limit(0), model, keep=["doc_id"]).count() == 0
