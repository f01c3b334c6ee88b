"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights are trained with follow-the-regularised-leader (per-coordinate rates, elastic net: the L1 part keeps weights
at exactly zero) and the probabilities are calibrated with one temperature. Document frequencies come from all
documents that may be learned from. Weights come from a sample bounded by `per_language` rows for each language (an
expected number: rows are chosen by a hash of the id, so no task gathers a language), of which one bucket in eight is
kept for the temperature. Buckets are trained side by side and averaged after every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stored, averaged

BITS = 14
SIZE = 1 << BITS
ORDERS = 3
BLOCK_CHARS = 1 << 20
BLOCK_ROWS = 32
BUCKETS = 8
UNKNOWN = "und"
_STEP = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """How often each hashed n-gram occurs in the letters of the whole text, one blank between runs; None without a letter."""
    counts, tail, letters = np.zeros(SIZE), np.array([32], dtype=np.uint32), letter_table()
    any_letter = False
    for first in range(0, len(text), BLOCK_CHARS):
        part = text[first:first + BLOCK_CHARS].lower()
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[chars]
        any_letter |= bool(is_letter.any())
        chars = np.concatenate([tail, np.where(is_letter, chars, np.uint32(32))])
        run = np.ones(len(chars), dtype=bool)
        run[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
        done, chars = len(tail), chars[run]
        done = int(run[:done].sum())  # n-grams that lie in the tail alone were counted before
        grams = chars * _STEP[0]
        for order in range(1, ORDERS + 1):
            if order > 1:
                if len(chars) < order:
                    break
                grams = grams[:-1] * _STEP[1] + chars[order - 1:] * _STEP[2]
            new = grams[max(0, done - order + 1):] if first else grams
            counts += np.bincount((new ^ (new >> np.uint32(15))) * _STEP[0] >> np.uint32(32 - BITS), minlength=SIZE)
        tail = chars[-(ORDERS - 1):]
    return counts if any_letter else None


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SIZE x languages
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return vectors(counts, self.idf) @ self.weights

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = np.exp((logits - logits.max(axis=1, keepdims=True)) / self.temperature)
        return x / x.sum(axis=1, keepdims=True)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


class Leader:
    """Follow-the-regularised-leader state; weights follow from it."""

    def __init__(self, z: np.ndarray, n: np.ndarray, rate: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n, self.rate, self.beta, self.l1, self.l2 = z, n, rate, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.rate + self.l2)

    def learn(self, x: np.ndarray, label: int) -> None:
        rows = np.flatnonzero(x)
        w, values = self.weights(rows), x[rows]
        scores = values @ w
        p = np.exp(scores - scores.max())
        p /= p.sum()
        p[label] -= 1.0
        g = np.outer(values, p)
        n = self.n[rows]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate
        self.z[rows] += g - sigma * w
        self.n[rows] = n + g * g


def held_out(id: Column) -> Column:  # noqa: A002
    return F.coalesce(F.crc32(id.cast("string")), F.lit(0)) % 5 == 0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each n-gram, documents with a letter) of the column `text`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(SIZE + 1, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                counts = gram_counts(value.as_py() or "")
                if counts is not None:
                    found[:SIZE] += counts > 0
                    total += 1
        found[SIZE] = total
        places = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(found[places])], names=["gram", "docs"])

    rows = docs.select("text").mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas()
    out = np.zeros(SIZE + 1)
    out[rows["gram"]] = rows["docs"]
    return out[:SIZE], int(out[SIZE])


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "lang",  # noqa: A002
          per_language: int = 1000, rounds: int = 3, most_languages: int = 1000) -> Model | None:
    """A model from the rows that are not held out and have a label; None if there is none.

    Bounds: about `per_language` rows a language are learned from, and there are at most `most_languages` languages.
    """
    spark, store = docs.sparkSession, Stored(docs.sparkSession, "language_id")
    rows = docs.where(~held_out(docs[id]) & docs[label].isNotNull()).select(
        docs[id].cast("string").alias("id"), docs[text].alias("text"), docs[label].cast("string").alias("label"))
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().orderBy("label").limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    frequency, total = document_frequencies(rows)
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0

    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    places = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    unit = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(1)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = store.put(rows.where(unit < rates[F.col("label")]).select(
        F.xxhash64(F.coalesce("id", F.lit("")), F.lit(2)).alias("turn"), "text", places[F.col("label")].alias("label"),
        F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(3)), F.lit(BUCKETS)).cast("int").alias("bucket")))

    state = {"z": np.zeros((SIZE, len(languages))), "n": np.zeros((SIZE, len(languages)))}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((state["z"], state["n"], idf))

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            z, n, weight = shared.value
            leader = Leader(z.copy(), n.copy())
            for row in part.sort_values(["turn", "text"]).itertuples():
                counts = gram_counts(row.text or "")
                if counts is not None:
                    leader.learn(vectors(counts, weight), row.label)
            return pd.DataFrame({"rows": [len(part)], "z": [leader.z.tobytes()], "n": [leader.n.tobytes()]})

        parts = sample.where("bucket > 0").groupBy("bucket").applyInPandas(fit, "rows long, z binary, n binary").toPandas()
        shape = (SIZE, len(languages))
        state = averaged({"rows": r.rows, "z": np.frombuffer(r.z).reshape(shape), "n": np.frombuffer(r.n).reshape(shape)}
                         for r in parts.itertuples()) or state
        shared.unpersist()
    model = Model(languages, idf.astype(np.float32), Leader(state["z"], state["n"]).weights().astype(np.float32))
    model.temperature = calibrated(model, sample.where("bucket = 0"))
    store.drop(sample)
    return model


def calibrated(model: Model, sample: DataFrame) -> float:
    """The temperature with the least log loss on rows that the weights have not seen (a bucket of the bounded sample)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts = gram_counts(value.as_py() or "")
                if counts is not None:
                    scores = model.logits(counts[None, :].astype(np.float32))[0].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([scores.tolist()]), pa.array([label], type=pa.int32())], names=["scores", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "scores array<double>, label int").toPandas()
    if rows.empty:
        return 1.0
    scores, labels = np.array(rows["scores"].tolist()), rows["label"].to_numpy()

    def loss(log_t: float) -> float:
        x = scores / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]))

    grid = np.linspace(-4.0, 3.0, 141)
    return float(np.exp(grid[int(np.argmin([loss(t) for t in grid]))]))


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score.

    A null text and one without a letter are `und` with score 0, as is every text if there is no model. Only the text
    is looked at; repeated rows get equal results; an empty table stays empty. Columns lang_pred and score of docs
    are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        own = shared.value
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        block, owners = np.zeros((BLOCK_ROWS, SIZE), dtype=np.float32), []

        def judge() -> None:
            p = own.probabilities(own.logits(block[: len(owners)]).astype(float))
            for k, best in enumerate(p.argmax(axis=1)):
                names[owners[k]], scores[owners[k]] = own.languages[best], p[k, best]
            owners.clear()

        for at, value in enumerate(texts):
            counts = gram_counts(value.as_py() or "") if own is not None else None
            if counts is not None:
                block[len(owners)] = counts
                owners.append(at)
            if len(owners) == BLOCK_ROWS:
                judge()
        if owners:
            judge()
        return pa.StructArray.from_arrays([pa.array(names, type=pa.string()), pa.array(scores)], ["lang_pred", "score"])

    # the text alone goes to Python, and only the judgement comes back: whole rows would lie in several buffers each
    judged = F.arrow_udf(run, "struct<lang_pred:string,score:double>")(docs[text])
    return docs.select(*[docs[c] for c in kept], judged.alias("_op_judged")).select(*kept, "_op_judged.lang_pred", "_op_judged.score")
