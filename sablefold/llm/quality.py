"""Quality: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features describe the line itself and both
neighbours: how long it is, what its bytes and words are like, how much it
repeats.  Documents carry the labels, not lines, so a logistic model of lines
first finds the lines of bad documents that look bad; the field then learns
those sequences.  A document's quality is the mean of the lines' forward-
backward marginals, weighted by length, calibrated on the documents learned
from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labels import training_rows
from .session import prepare
from .toxicity import score_documents
from .words import IS_SPACE, U, Slab, slabs, word_hashes, word_spans

MOST, STEPS, RIDGE = 2000, 60, 1e-3
#: Frequent words of English, French, German and Spanish text.
FREQUENT = "the of and to in a is that it was for on are as with be this by from or an at le la les de des du et un une en que est pour dans qui sur der die das und ist nicht ein eine zu mit von den el los las y del se por con no su para"
_CLASSES = np.zeros(256, np.int64)  # 0 other letters
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 3
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-"]] = 4
_CLASSES[[32, 9, 10, 11, 12, 13]] = 5


def _frequent() -> np.ndarray:
    text = pa.array([FREQUENT])
    slab = next(slabs(text))
    starts, ends, _ = word_spans(slab)
    return np.sort(word_hashes(slab, starts, ends))


_FREQUENT = _frequent()


def line_features(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word, its number of bytes, and the number of such lines in each text."""
    data, n = slab.data, len(slab.data)
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([slab.offsets[:-1][slab.offsets[:-1] < n], feed[feed + 1 < n] + 1])) if n else np.empty(0, np.int64)
    end = np.append(begin[1:], n)
    starts, ends, _ = word_spans(slab)
    first = np.searchsorted(starts, begin)
    words = np.append(first[1:], len(starts)) - first
    keep = words > 0
    begin, end, words = begin[keep], end[keep], words[keep]
    counts = np.diff(np.searchsorted(begin, slab.offsets))
    lines = len(begin)
    if not lines:
        return np.empty((0, 12)), np.empty(0), counts
    kinds = _CLASSES[data]
    share = []
    for k in range(1, 6):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        share.append((total[end] - total[begin]).astype(float))
    upper, digit, stops, marks, space = share
    size = np.maximum(end - begin - space, 1)
    line = np.repeat(np.arange(lines), words)
    h = word_hashes(slab, starts, ends)
    per = lambda hit: np.bincount(line[hit], minlength=lines) / words
    at = np.minimum(np.searchsorted(_FREQUENT, h), len(_FREQUENT) - 1)
    frequent = per(_FREQUENT[at] == h)
    last = kinds[ends - 1]
    key = np.sort((line.astype(U) << U(40)) | (h >> U(24)))
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    distinct = np.bincount((key[fresh] >> U(40)).astype(np.int64), minlength=lines) / words
    lone = (ends - starts == 1) & (last == 4)
    x = np.stack([
        np.log1p(words), np.log(size / words + 1), upper / size, digit / size, stops / size, marks / size,
        np.log1p(marks), frequent, distinct, per(last == 4), per(lone), np.log1p(words) * (1 - distinct),
    ], axis=1)
    return x, size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bias, the line's features, and those of the line before and after in its text (its own at the ends)."""
    n = len(x)
    first = np.zeros(n + 1, bool)
    edges = np.concatenate([[0], np.cumsum(counts)])
    first[edges] = True
    i = np.arange(n)
    return np.hstack([np.ones((n, 1)), x, x[np.where(first[:-1], i, i - 1)], x[np.where(first[1:], i, i + 1)]])


def _lse(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=1, keepdims=True)))[:, 0]


def marginals(node: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected transitions, over all texts at once.

    ``node``: the log-odds of good from a line's own features.
    """
    n = len(node)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    psi = np.stack([np.zeros(n), node], axis=1)
    longest = int(counts.max()) if len(counts) else 0
    by = np.argsort(-counts, kind="stable")
    live = np.searchsorted(-counts[by], -np.arange(1, longest + 1), "right")
    for t in range(longest):
        at = begin[by[: live[t]]] + t
        alpha[at] = psi[at]
        if t:
            p = alpha[at - 1]
            alpha[at] += np.stack([np.logaddexp(p[:, 0] + trans[0, j], p[:, 1] + trans[1, j]) for j in (0, 1)], axis=1)
    for t in range(longest - 2, -1, -1):
        at = begin[by[: live[t + 1]]] + t
        q = beta[at + 1] + psi[at + 1]
        beta[at] = np.stack([np.logaddexp(q[:, 0] + trans[i, 0], q[:, 1] + trans[i, 1]) for i in (0, 1)], axis=1)
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    expected = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[begin[counts > 0]] = False
    k = np.flatnonzero(inner)
    if len(k):
        joint = alpha[k - 1][:, :, None] + trans[None] + (psi[k] + beta[k])[:, None, :]
        joint = joint.reshape(-1, 4)
        expected = np.exp(joint - _lse(joint)[:, None]).sum(axis=0).reshape(2, 2)
    return good, expected


def _adam(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(rows: list[tuple[str, int]], steps: int = STEPS) -> dict:
    """Scales, weights, transitions and calibration; plain arrays of fixed size."""
    xs, sizes, counts = [], [], []
    for slab in slabs(pa.array([t for t, _ in rows], pa.string())):
        x, s, c = line_features(slab)
        xs.append(x), sizes.append(s), counts.append(c)
    label = np.array([y for _, y in rows], float)
    x, size, count = (np.concatenate(a) if a else np.empty(0) for a in (xs, sizes, counts))
    if not len(x) or label.min() == label.max():
        return {"prior": float(label.mean()) if len(label) else 0.5}
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = with_neighbours((x - mean) / std, count)
    of = np.repeat(label, count)
    # Each text weighs the same, each class half of all.
    balance = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    total = np.bincount(np.repeat(np.arange(len(count)), count), size, len(count))
    weight = size * np.repeat(balance / np.maximum(total, 1), count)
    odds = lambda w: 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
    truth = of.copy()
    w = np.zeros(x.shape[1])
    for _ in range(2):
        w = _adam(lambda w: x.T @ (weight * (odds(w) - truth)) + RIDGE * w, w, 2 * steps, 0.1)
        # In a bad text the lines that look good are good; if all do, its worst line is bad.
        good = odds(w)
        worst = np.full(len(count), np.inf)
        np.minimum.at(worst, np.repeat(np.arange(len(count)), count), good)
        truth = np.where((of == 0) & (good > 0.5) & (good > np.repeat(worst, count)), 1.0, of)
    line_weight = np.repeat(balance, count) / np.repeat(np.maximum(count, 1), count)
    state = truth.astype(int)
    inner = np.ones(len(x), bool)
    inner[(np.concatenate([[0], np.cumsum(count)])[:-1])[count > 0]] = False
    k = np.flatnonzero(inner)
    seen = np.bincount(state[k - 1] * 2 + state[k], minlength=4).reshape(2, 2) if len(k) else np.zeros((2, 2))

    def gradient(p: np.ndarray) -> np.ndarray:
        g, expected = marginals(x @ p[4:], count, p[:4].reshape(2, 2))
        return np.concatenate([((expected - seen) / max(1, len(k)) + 1e-2 * p[:4].reshape(2, 2)).ravel(), x.T @ (line_weight * (g - truth)) + RIDGE * p[4:]])

    p = _adam(gradient, np.concatenate([np.zeros(4), w]), steps, 0.05)
    model = {"mean": mean, "std": std, "trans": p[:4].reshape(2, 2), "w": p[4:], "scale": (1.0, 0.0), "prior": float(label.mean())}
    good, _ = marginals(x @ model["w"], count, model["trans"])
    q = np.bincount(np.repeat(np.arange(len(count)), count), good * size, len(count)) / np.maximum(total, 1)
    has = count > 0
    z = np.stack([_logit(q[has]), np.ones(has.sum())], axis=1)
    ab = np.zeros(2)
    for _ in range(30):
        s = 1 / (1 + np.exp(-np.clip(z @ ab, -35, 35)))
        ab = ab - np.linalg.solve(z.T @ (z * (s * (1 - s))[:, None]) + 1e-3 * np.eye(2), z.T @ (s - label[has]) + 1e-3 * ab)
    return model | {"scale": (float(ab[0]), float(ab[1]))}


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def score_texts(column: pa.Array, model: dict) -> np.ndarray:
    """Quality of every text; 0 for one without a word."""
    out = np.zeros(len(column))
    for slab in slabs(column):
        x, size, count = line_features(slab)
        if "w" not in model:
            out[slab.lo : slab.hi] = np.where(count > 0, model["prior"], 0.0)
        elif len(x):
            node = with_neighbours((x - model["mean"]) / model["std"], count) @ model["w"]
            good, _ = marginals(node, count, model["trans"])
            of = np.repeat(np.arange(len(count)), count)
            q = np.bincount(of, good * size, len(count)) / np.maximum(np.bincount(of, size, len(count)), 1)
            a, b = model["scale"]
            out[slab.lo : slab.hi] = np.where(count > 0, 1 / (1 + np.exp(-(a * _logit(q) + b))), 0.0)
    return out


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    ``labels(doc_id, quality)`` outside the held-out fold teach the field, from
    at most ``most`` documents.  Null, empty and blank texts score 0.  A null
    doc_id isn't held out.  With labels of one kind only, every other text
    scores their share of good ones (0.5 without labels).
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(train(training_rows(docs, labels, "quality", most)))
    return score_documents(docs, lambda column: score_texts(column, sent.value), threshold)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
