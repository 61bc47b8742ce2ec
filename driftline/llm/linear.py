"""Sparse linear models fitted on the driver from bounded samples, and their calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash values of ids below share * RANGE are in a sample.
RANGE = 1 << 30


def in_sample(share: float | Column, salt: str = "") -> Column:
    """A repeatable sample by a hash of doc_id."""
    h = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), F.lit(RANGE))
    return h < (share * RANGE if isinstance(share, Column) else F.lit(int(min(1.0, share) * RANGE)))


@dataclass
class Sparse:
    """Rows of (feature, value) pairs."""

    start: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        sizes = [len(f) for f, _ in rows]
        start = np.concatenate(([0], np.cumsum(sizes))).astype("i8")
        join = lambda k, kind: np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.empty(0, kind)
        return cls(start, join(0, "i8"), join(1, "f8"))

    def __len__(self) -> int:
        return len(self.start) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.start[i], self.start[i + 1])
        return self.feature[s], self.value[s]

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Rows times a matrix (features x classes)."""
        row = np.repeat(np.arange(len(self)), np.diff(self.start))
        return np.stack([np.bincount(row, self.value * w[self.feature, c], len(self)) for c in range(w.shape[1])], 1)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def ftrl(x: Sparse, y: np.ndarray, dim: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.5, epochs: int = 3, seed: int = 3, free: int = -1) -> np.ndarray:
    """Follow-the-regularised-leader with elastic net, by coordinate.

    ``y`` is rows x classes; one column means a logistic model, more a multinomial one. The feature
    ``free`` (the bias) has no penalty.
    """
    classes = y.shape[1]
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    first, second = np.full((dim, 1), l1), np.full((dim, 1), l2)
    if free >= 0:
        first[free] = second[free] = 0

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) > first[f], (np.sign(zf) * first[f] - zf) / ((beta + np.sqrt(n[f])) / alpha + second[f]), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            f, v = x.row(i)
            w = weights(f)
            s = v @ w
            p = sigmoid(s) if classes == 1 else softmax(s)
            g = v[:, None] * (p - y[i])
            root = np.sqrt(n[f])
            n[f] += g * g
            z[f] += g - (np.sqrt(n[f]) - root) / alpha * w
    return weights(np.arange(dim))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search on its log."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A small dense logistic model with a bias in front, by damped Newton steps."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(documents: DataFrame, labels: DataFrame, bound: int, columns: list[str]) -> DataFrame:
    """About ``bound`` labelled documents at most: ``columns`` of documents, quality and toxic.

    Several labels of one id count as the worst of them. Only sampled texts are shuffled.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    total = labels.select(F.count("doc_id")).first()[0]
    share = bound / max(total, bound)
    return documents.select(*columns).filter(in_sample(share)).join(known.filter(in_sample(share)), "doc_id")
