"""Sparse hashed text features and small linear models fitted on a bounded sample.

Features are made on the executors; the driver sees at most ``max_rows`` labelled rows of at
most a few thousand (index, value) pairs each. Everything that applies a model covers all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rows:
    """Sparse rows: indices and values end to end, with each row's bounds."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        lengths = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.size, self.n = size, len(rows)
        self.at = np.repeat(np.arange(len(rows)), lengths)
        self.index = np.concatenate([i for i, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * w[self.index], minlength=self.n)

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * r[self.at], minlength=self.size)

    def take(self, keep: np.ndarray) -> Rows:
        """The rows where ``keep`` holds."""
        out = object.__new__(Rows)
        m = keep[self.at]
        new = np.cumsum(keep) - 1
        out.size, out.n, out.at, out.index, out.value = self.size, int(keep.sum()), new[self.at[m]], self.index[m], self.value[m]
        return out


def adam(gradient, start: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def accelerated(gradient, start: np.ndarray, curvature: float, steps: int = 200) -> np.ndarray:
    """Nesterov's gradient descent with the step 1 / curvature; deterministic."""
    x, y, a = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        x, before = y - gradient(y) / curvature, x
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        y = x + (a - 1) / b * (x - before)
        a = b
    return x


def largest_eigenvalue(times, size: int, rounds: int = 15) -> float:
    """Power iteration on a positive semi-definite map."""
    v = np.full(size, 1 / np.sqrt(max(1, size)))
    length = 0.0
    for _ in range(rounds):
        v = times(v)
        length = float(np.sqrt(v @ v))
        if length == 0.0:
            return 0.0
        v /= length
    return length


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``max_rows`` labelled texts ``id, y0, y1, ..., body``, the same ones at each run: by a hash of the id.

    Labels with a null id or null rating are left out; of several ratings of an id the smallest
    counts, of several texts of an id the smallest. The join takes the sampled labels only,
    which are few, to the documents.
    """
    ys = [f"y{k}" for k in range(len(label_cols))]
    rated = labels.select(labels[id_col].alias("id"), *[labels[c].alias(y) for y, c in zip(ys, label_cols)]).dropna()
    rated = rated.groupBy("id").agg(F.min(F.struct(*ys)).alias("y")).select("id", "y.*")
    picked = rated.orderBy(F.xxhash64(F.lit("sample"), F.col("id")), "id").limit(max_rows)
    texts = docs.select(docs[id_col].alias("doc"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"))
    found = texts.join(F.broadcast(picked), F.col("doc") == F.col("id"))
    return found.groupBy("id", *ys).agg(F.min("body").alias("body"))
