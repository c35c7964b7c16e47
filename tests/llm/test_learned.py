"""Classifiers: held-out accuracy, bounds, and edges."""

import numpy as np
import pyarrow as pa
from helpers import EDGES, documents, empty, held_out

from sablefold.llm import quality, toxicity


def learned(spark, sf_dir, run, target, threshold):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = run(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    kept = [r for r in rows if r.held_out]
    right = {y: np.mean([r.predicted == y for r in kept if r[target] == y]) for y in (0, 1)}
    assert len(kept) > 500
    return right


def test_quality_on_documents_it_never_saw(spark, sf_dir):
    right = learned(spark, sf_dir, quality.quality, "quality", 0.3)
    assert min(right.values()) > 0.97


def test_toxicity_on_documents_it_never_saw(spark, sf_dir):
    right = learned(spark, sf_dir, toxicity.toxicity, "toxic", 0.5)
    assert right[1] > 0.8 and right[0] > 0.98


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (quality.quality, toxicity.toxicity):
        for known in (labels, labels.limit(0)):
            rows = run(documents(spark), known).collect()
            assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
        assert run(empty(spark), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(documents(spark), labels.limit(0)).collect()} == {0.5}
    assert [r.score for r in quality.quality(documents(spark), labels).collect() if r.doc_id in (4, 5, 6)] == [0.0] * 3


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 1, 4])
    node, trans = rng.standard_normal(8), rng.standard_normal((2, 2))
    got, expected = quality.marginals(node, counts, trans)
    at, seen = 0, np.zeros((2, 2))
    for n in counts:
        if not n:
            continue
        weights = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weights[tuple(y)] = np.exp(sum(node[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        for i in range(n):
            assert abs(got[at + i] - sum(w for y, w in weights.items() if y[i]) / z) < 1e-9
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                seen[a, b] += w / z
        at += n
    assert np.allclose(seen, expected)


def test_whole_texts_count(spark):
    """The telling word stands at the very end of a long text."""
    rows = [("calm words here " * 5 + ("vileword" if i % 3 == 0 else "kind"), int(i % 3 == 0)) for i in range(3000)]
    weights = toxicity.train(rows)
    long = "calm words here " * 50_000
    low, high = toxicity.score_texts(pa.array([long + "kind", long + "vileword"]), weights)
    assert low < 0.5 < high
