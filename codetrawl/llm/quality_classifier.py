"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score): one score for each text, a sum of weights that all grades share, and
ordered thresholds between neighbouring grades. The score sums 64-bit hashed features that a text has (each once): its
words, and how frequent every ASCII symbol, capitals and repeated words are. Weights get per-coordinate rates and an L1
penalty, so most of them are exactly zero and the model holds only words that matter. It is fitted on a bounded
sample of rated rows in buckets, side by side, averaged after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, Stored, Words, mixed, text_batches

BLOCK_BYTES = 1 << 20
BUCKETS = 8
RATES = np.array([0.0, 0.01, 0.03, 0.1, 0.3, 0.7])
CAPITAL, REPEATED = 128, 129


def features(rolling: Rolling, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature): every feature a text has, once, in the order of texts."""
    words = Words(rolling, texts)
    order = np.lexsort((words.hashes, words.owner))
    owner, hashes = words.owner[order], words.hashes[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    per_text = np.maximum(np.diff(words.bounds), 1)

    counts = np.zeros((len(texts), 130))
    for k, text in enumerate(texts):
        found = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)[:128]
        counts[k, :128] = found
        counts[k, CAPITAL] = found[0x41:0x5B].sum() / 5
    counts[:, 0x30:0x3A] = counts[:, 0x41:0x5B] = counts[:, 0x61:0x7B] = 0
    counts[:, REPEATED] = np.diff(words.bounds) - np.bincount(owner[first], minlength=len(texts))
    level = np.searchsorted(RATES, counts / per_text[:, None], side="left")
    who, what = np.nonzero(level)
    rates = mixed((what * 8 + level[who, what]).astype(np.uint64) + np.uint64(1))
    owners = np.concatenate([owner[first], who])
    return owners[turn := np.argsort(owners, kind="stable")], np.concatenate([hashes[first], rates])[turn]


@dataclass
class Model:
    """Weights of sorted hashes, and thresholds in ascending order; with K thresholds the grades are 0 to K."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, owners: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(texts)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.bincount(owners, np.where(self.hashes[at] == hashes, self.weights[at], 0.0), minlength=texts)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold k."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - scores[:, None], -60, 60)))


@dataclass
class Fit:
    """Sorted hashes with the sums of follow-the-regularised-leader, and thresholds."""

    thresholds: np.ndarray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate, beta, l1, l2 = 1.0, 1.0, 2.5, 0.02

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0) / ((self.beta + np.sqrt(self.n[at])) / self.rate + self.l2)

    def extended(self, hashes: np.ndarray) -> Fit:
        every = np.union1d(self.hashes, hashes)
        out = Fit(self.thresholds.copy(), every, np.zeros(len(every)), np.zeros(len(every)))
        at = np.searchsorted(every, self.hashes)
        out.z[at], out.n[at] = self.z, self.n
        return out

    def learn(self, at: np.ndarray, grade: int) -> None:
        """One gradient step on the log loss of a rated text with the features at these places."""
        w = self.weights(at)
        below = 1.0 / (1.0 + np.exp(np.clip(w.sum() - self.thresholds, -60, 60)))  # P(grade <= k)
        edges = np.concatenate([[0.0], below, [1.0]])
        low, high = edges[grade], edges[grade + 1]
        p = max(high - low, 1e-9)
        g = 1.0 - high - low
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.rate
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        slope = edges * (1.0 - edges) / p
        step = np.zeros(len(edges))
        step[grade + 1] -= slope[grade + 1]
        step[grade] += slope[grade]
        self.thresholds = np.maximum.accumulate(self.thresholds - 0.02 * np.clip(step[1:-1], -5, 5))


def train(docs: DataFrame, ratings: DataFrame, *, id: str = "doc_id", text: str = "text", grade: str = "grade",  # noqa: A002
          grades: int = 3, most_rows: int = 10_000, rounds: int = 6) -> Model:
    """A model from `ratings` (id, grade from 0 to grades - 1). Bound: about `most_rows` ratings, chosen by a hash of the id.

    Ratings that are null or out of range and those of documents that are not there are left out; without any the
    model knows nothing and every text has the same grade. A null text is an empty one.
    """
    spark, store = docs.sparkSession, Stored(docs.sparkSession, "quality")
    rated = ratings.select(ratings[id].alias("id"), ratings[grade].cast("int").alias("grade")).where(f"id is not null and grade between 0 and {grades - 1}")
    share = min(1.0, most_rows / max(1, rated.count()))
    unit = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = store.put(rated.where(unit < share).dropDuplicates(["id", "grade"]))
    sample = store.put(docs.select(docs[id].alias("id"), docs[text].alias("text")).join(chosen, "id").select(
        "grade", "text", F.xxhash64("id", F.lit(2)).alias("turn"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(BUCKETS)).alias("bucket")))
    fit = Fit(np.linspace(-1.0, 1.0, grades - 1))
    total = sample.count()
    for _ in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast(fit)

        def step(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["turn", "text", "grade"])
            rolling = Rolling()
            seen = [features(rolling, [(value or "").encode()])[1] for value in part["text"]]
            every, texts = np.unique(np.concatenate(seen), return_counts=True)
            every = every[texts > 1]  # what a single text has says nothing about others
            own = shared.value.extended(every)
            for hashes, label in zip(seen, part["grade"]):
                at = np.searchsorted(own.hashes, hashes)
                at = at[own.hashes[np.minimum(at, len(own.hashes) - 1)] == hashes] if len(own.hashes) else at[:0]
                own.learn(at, int(label))
            rows, used = len(part), np.flatnonzero(own.n > 0)
            places = np.arange(len(own.thresholds))  # thresholds travel along, marked by their place
            return pd.DataFrame({
                "threshold": np.concatenate([places, np.full(len(used), -1)]),
                "hash": np.concatenate([places * 0, own.hashes[used].view(np.int64)]),
                "z": rows * np.concatenate([own.thresholds, own.z[used]]), "n": rows * np.concatenate([places * 0.0, own.n[used]])})

        parts = sample.groupBy("bucket").applyInPandas(step, "threshold int, hash long, z double, n double")
        found = parts.groupBy("threshold", "hash").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
        thresholds = found[found["threshold"] >= 0].sort_values("threshold")["z"].to_numpy() / total
        found = found[found["threshold"] < 0]
        hashes = found["hash"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(hashes)
        fit = Fit(thresholds, hashes[order], found["z"].to_numpy()[order] / total, found["n"].to_numpy()[order] / total)
        shared.unpersist()
    weights = fit.weights()
    store.drop(sample)
    return Model(fit.hashes[weights != 0], weights[weights != 0], fit.thresholds)


def grade(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text", least: int = 2, share: float = 0.5) -> DataFrame:
    """The columns `keep` of docs with expected_grade, tail_probability (of a grade of at least `least`) and selected.

    A null text is graded as an empty one; equal texts get equal grades; an empty table stays empty. Columns of docs
    named like a result must not be among `keep`.
    """
    rows = docs.select(*keep, F.col(text).alias("_op_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, own = Rolling(), shared.value
        for batch in batches:
            for first, block in text_batches(batch, "_op_text", BLOCK_BYTES):
                tails = own.tails(own.scores(*features(rolling, block), len(block)))
                part = batch.slice(first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(tails[:, least - 1]), pa.array(tails[:, least - 1] >= share)],
                    names=[*keep, "expected_grade", "tail_probability", "selected"])

    schema = rows.select(*keep, F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability"), F.lit(True).alias("selected")).schema
    return rows.mapInArrow(run, schema)
