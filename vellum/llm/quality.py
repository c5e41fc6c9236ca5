"""Quality by a Naive Bayes support vector machine on binary n-gram indicators.

Indicators are hashed: words, pairs of words, and one to three neighbouring word shapes (which kinds of characters a
word holds, whether it has one character, whether it repeats the word before). Each indicator is scaled by the log-count
ratio of the classes (Wang and Manning), each document to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent (Hsieh and others). A logistic curve, fitted on a part of the sample that the model did not see,
turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, held_out, mix64, replaced, slices, small_batches, with_fields
from .words import spans, word_hashes

BITS = 18
SHAPE = np.zeros(256, np.uint8)
SHAPE[ord("a") : ord("z") + 1] = 1
SHAPE[ord("A") : ord("Z") + 1] = 2
SHAPE[ord("0") : ord("9") + 1] = 4
SHAPE[128:] = 1
for _b in b".,;:'\"()-":
    SHAPE[_b] = 8
for _b in b"!?":
    SHAPE[_b] = 16
for _b in b"#$%&*+/<=>@[\\]^_`{|}~":
    SHAPE[_b] = 32


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashed indicators; a text without words has none."""
    raw = b" ".join(texts)
    data = np.frombuffer(raw, np.uint8)
    s, e = spans(data)
    if not len(s):
        return [np.zeros(0, np.int64)] * len(texts)
    words = word_hashes(np.frombuffer(raw.lower(), np.uint8), s, e)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), s, side="right")
    same = np.zeros(len(s), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    shape = np.bitwise_or.reduceat(SHAPE[data], s).astype(np.uint64) | ((e - s == 1).astype(np.uint64) << np.uint64(6)) | (same.astype(np.uint64) << np.uint64(7))
    kinds = [(words, 0), (mix64(words[:-1] * np.uint64(3) + words[1:]), 1), (mix64(shape + np.uint64(1 << 40)), 0)]
    two = shape[:-1] << np.uint64(8) | shape[1:]
    kinds += [(mix64(two + np.uint64(2 << 40)), 1), (mix64((two[:-1] << np.uint64(8) | shape[2:]) + np.uint64(3 << 40)), 2)]
    found = []
    for values, back in kinds:
        inside = doc[: len(values)] == doc[back:]
        found.append((doc[: len(values)][inside].astype(np.int64) << BITS) | (values[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    every = np.unique(np.concatenate(found))
    cuts = np.searchsorted(every, np.arange(1, len(texts)) << BITS)
    return [x & ((1 << BITS) - 1) for x in np.split(every, cuts)]


def all_indicators(texts: list[str | None]) -> list[np.ndarray]:
    return [x for _, raw in slices(texts) for x in indicators(raw)]


class NaiveBayesSvm:
    """Weights over scaled indicators, an intercept, and the logistic curve (slope, shift) for probabilities."""

    def __init__(self, weights: np.ndarray, bias: float, ratio: np.ndarray, slope: float, shift: float):
        self.bias, self.slope, self.shift = bias, slope, shift
        self.scaled, self.squares = (weights * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)

    def margin(self, x: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[x].sum()))
        return float(self.scaled[x].sum()) / norm + self.bias if norm > 0 else self.bias

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30))))


def fit_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log of the ratio of the classes' smoothed shares of each indicator."""
    counts = np.ones((2, 1 << BITS))
    for x, c in zip(rows, y, strict=True):
        counts[int(c), x] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 12, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Minimise |w|^2 / 2 + sum cost * hinge(y (w x + b)) with the intercept as a feature of value one."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    sign, rng = np.where(y > 0, 1.0, -1.0), np.random.default_rng(0)
    diagonal = np.array([float(v @ v) + 1 for v in values])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                worst = max(worst, abs(step))
                w[x] += step * v
                bias += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, bias


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, with Platt's smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((np.logaddexp(0, z) - target * z).sum()) + 5e-4 * a * a

    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        r, q = target - p, p * (1 - p) + 1e-9
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]])
        da, db = np.linalg.solve(h, [(r * margins).sum() - 1e-3 * a, r.sum()])
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a + size * da, b + size * db) > now:
            size /= 2
        a, b = a + size * da, b + size * db
    return max(a, 1e-6), b


def fit(texts: list[str | None], labels: list[int], c: float = 1.0) -> NaiveBayesSvm:
    """A model from labelled texts; every fifth one only serves the logistic curve. With one class only, its share is every score."""
    y = np.array(labels, float)
    rows = all_indicators(texts)
    if len(set(labels)) < 2:
        zero = np.zeros(1 << BITS)
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return NaiveBayesSvm(zero, 0.0, zero, 1.0, float(np.log(share / (1 - share))))
    last = np.zeros(len(y), bool)
    for k in (0, 1):
        last[np.flatnonzero(y == k)[::5]] = (y == k).sum() >= 10
    own = np.flatnonzero(~last)
    ratio = fit_ratio([rows[i] for i in own], y[own])
    norms = [float(np.sqrt((ratio[x] ** 2).sum())) or 1.0 for x in rows]
    share = y[own].mean()
    cost = np.where(y[own] > 0, c * 0.5 / share, c * 0.5 / (1 - share))
    w, b = dual_coordinate_descent([rows[i] for i in own], [ratio[rows[i]] / norms[i] for i in own], y[own], 1 << BITS, cost)
    model = NaiveBayesSvm(w, b, ratio, 1.0, 0.0)
    seen = np.flatnonzero(last) if last.any() else own
    model.slope, model.shift = fit_curve(np.array([model.margin(rows[i]) for i in seen]), y[seen])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, max_chars: int = 50_000) -> NaiveBayesSvm:
    """Fit, in an executor, on a bounded sample of about ``rows`` labelled documents outside the held-out fifth, each of at most ``max_chars``."""
    return fitted(docs, labels, "quality", fit, rows, max_chars)


def quality_scores(docs: DataFrame, model: NaiveBayesSvm, threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score, predicted (score >= ``threshold``), replacing columns of those names.

    Whole texts are scored. A null or empty text has no indicators and gets the model's base score; a null doc_id is
    held out. Every row is kept, repeated ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.scaled, model.squares, model.bias, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, squares, bias, slope, shift = sent.value
        for b in small_batches(batches):
            margins = []
            for x in all_indicators(b.column("text").to_pylist()):
                norm = float(np.sqrt(squares[x].sum()))
                margins.append(float(scaled[x].sum()) / norm + bias if norm > 0 else bias)
            score = 1 / (1 + np.exp(-np.clip(slope * np.array(margins) + shift, -30, 30)))
            yield replaced(b, score=pa.array(score, pa.float64()), predicted=pa.array((score >= threshold).astype(np.int32)))

    own = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return own.mapInArrow(run, with_fields(own, "score double, predicted int"))
