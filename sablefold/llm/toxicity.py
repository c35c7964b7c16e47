"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct single words, pairs of neighbouring words
and pairs with one word between them, hashed to ``2**BITS`` places.  Each
coordinate has its own learning rate, and L1 keeps the weights of all but the
telling features at zero, so the model is a few thousand numbers at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_rows
from .session import prepare
from .words import U, mix, slabs, word_hashes, word_spans

BITS, MOST, EPOCHS = 20, 8000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 20.0, 1.0
HEAVY = 8.0  # at most so many times does a toxic text count
#: Bytes that don't belong to a word here: all of ASCII but letters, digits and the apostrophe.
OUTSIDE = np.array([b < 128 and not (chr(b).isalnum() or b == 39) for b in range(256)])


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts ``lo:hi``: the text (counted from ``lo``) and place of every feature, with repeats."""
    for slab in slabs(column):
        starts, ends, counts = word_spans(slab, OUTSIDE)
        h = word_hashes(slab, starts, ends)
        owner = np.repeat(np.arange(slab.hi - slab.lo), counts)
        places, owners = [mix(h, 21)], [owner]
        with np.errstate(over="ignore"):
            for gap in (1, 2):
                if len(h) > gap:
                    same = owner[gap:] == owner[:-gap]
                    places.append(mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:], 21 + gap)[same])
                    owners.append(owner[gap:][same])
        yield slab.lo, slab.hi, np.concatenate(owners), (np.concatenate(places) >> U(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for presence features; place ``2**BITS`` is the bias, which L1 spares."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.full(size + 1, L1)
        self.l1[size] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1[at] - z
        return np.where(np.abs(z) <= self.l1[at], 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights of all places, and of the bias last.  Without rows all are zero."""
    size = 1 << BITS
    model = Ftrl(size)
    sets: list[np.ndarray] = []
    for i in range(0, len(rows), 500):
        for lo, hi, owner, place in features(pa.array([t for t, _ in rows[i : i + 500]], pa.string())):
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(hi - lo + 1))
            place = place[order]
            sets += [np.append(np.unique(place[a:b]), size).astype(np.int32) for a, b in zip(edges, edges[1:])]
    toxic = sum(y for _, y in rows)
    heavy = min(HEAVY, (len(rows) - toxic) / toxic) if toxic else 1.0  # toxic texts are rare
    for e in range(epochs):
        for i in np.random.default_rng([seed, e]).permutation(len(sets)):
            model.learn(sets[i], rows[i][1], heavy if rows[i][1] else 1.0)
    return model.weights(np.arange(size + 1))


def score_texts(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    size = 1 << BITS
    telling = weights[:size] != 0
    for lo, hi, owner, place in features(column):
        hit = telling[place]
        pair = np.unique(owner[hit] * (size + 1) + place[hit])
        out[lo:hi] = np.bincount(pair // (size + 1), weights[pair % (size + 1)], hi - lo) + weights[size]
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score_documents(docs: DataFrame, score, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``score`` maps an Arrow column of texts to numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    ``labels(doc_id, toxic)`` outside the held-out fold teach the model, from at
    most ``most`` documents.  Null and empty texts score as the bias alone.  A
    null doc_id isn't held out.  Without labels every score is 0.5.
    """
    spark = docs.sparkSession
    prepare(spark)
    weights = train(training_rows(docs, labels, "toxic", most))
    nonzero = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((nonzero.astype(np.int32), weights[nonzero]))

    def score(column: pa.Array) -> np.ndarray:
        w = np.zeros((1 << BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        return score_texts(column, w)

    return score_documents(docs, score, threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
