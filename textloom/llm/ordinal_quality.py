"""Quality grades by ordinal cumulative-link regression on hashed text features.

Graded ratings 0 < 1 < ... < G share one weight vector; ordered thresholds t1 < t2 < ... give
P(grade >= g) = sigmoid(score - t_g). The model yields the expected grade and the tail
probability by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches
from textloom.llm.hashed_linear import Rows, adam, labelled_sample, sigmoid

#: Hashed dimensions, and the bound of the labelled sample the model is fitted on.
SIZE, MAX_ROWS = 1 << 15, 4_000
KEEP_GRADE, KEEP_TAIL = 1, 0.4


class _ShapeTable(dict):
    """Code points to what they are in a shape: A, a, 9, or themselves."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = found = ord("A") if c.isupper() else ord("a") if c.isalpha() else ord("9") if c.isdigit() else code
        return found


class _WordTable(dict):
    """Code points that are no word characters to nothing."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = found = code if c.isalnum() or c == "_" else None
        return found


class _ShapeIndex(dict):
    """Shapes, runs shortened to two, to hashed indices; bounded."""

    def __missing__(self, shape: str) -> int:
        if len(self) >= 20_000:
            self.clear()
        short = re.sub(r"(.)\1+", r"\1\1", shape, flags=re.S)[:12]
        self[shape] = found = zlib.crc32(b"s" + short.encode("utf-8", "surrogatepass")) % SIZE
        return found


_SHAPE_OF, _WORD_OF, _SHAPE_INDEX = _ShapeTable(), _WordTable(), _ShapeIndex()


class _Tokens(dict):
    """Tokens to the hashed indices of their word and shape; bounded."""

    def __missing__(self, token: str) -> tuple[int, int]:
        word = token.lower().translate(_WORD_OF)
        found = (zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % SIZE, _SHAPE_INDEX[token.translate(_SHAPE_OF)])
        if len(self) >= 100_000:
            self.clear()
        self[token] = found
        return found


_SHAPES = _Tokens()


def _forget() -> None:
    """Empty what a worker remembers, when its task ends."""
    _SHAPES.clear()
    _SHAPE_INDEX.clear()


_EXTRA = {name: zlib.crc32(b"x" + name.encode()) % SIZE for name in ("bias-length", "again", "distinct", "empty")}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and token shapes by their share of the text, with repetition and length.

    A value is the square root of the feature's share, so that a text's length alone does not
    move its score and frequent shapes do not drown the rest.
    """
    tokens = text.split()
    if not tokens:
        return np.array([_EXTRA["empty"]]), np.array([1.0])
    n = len(tokens)
    counts: Counter = Counter()
    for token, many in Counter(tokens).items():
        word, shape = _SHAPES[token]
        counts[word] += many
        counts[shape] += many
    again = sum(map(str.__eq__, tokens[1:], tokens[:-1]))
    index = np.fromiter(counts, dtype=np.int64, count=len(counts))
    value = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / n)
    more = {"bias-length": min(np.log1p(n) / 10, 1.0), "again": np.sqrt(again / n), "distinct": len(set(tokens)) / n}
    return np.concatenate([index, [_EXTRA[k] for k in more]]), np.concatenate([value, list(more.values())])


class OrdinalModel(NamedTuple):
    """Shared weights and ordered thresholds; grades run from 0 to the number of thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ...; one row for each score."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: Rows, grades: np.ndarray, n_grades: int, l2: float = 1e-4, steps: int = 300) -> OrdinalModel:
    """Maximum likelihood with a small ridge; increments keep the thresholds in order."""
    k = n_grades - 1
    y = grades.astype(int)
    weight = np.ones(len(y)) / max(1, len(y))

    def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps_up = np.exp(np.clip(x[rows.size + 1 :], -10, 5))
        return x[: rows.size], x[rows.size] + np.concatenate([[0.0], np.cumsum(steps_up)])

    def gradient(x: np.ndarray) -> np.ndarray:
        w, t = unpack(x)
        score = rows.dot(w)
        upper = np.where(y > 0, sigmoid(score - t[np.maximum(y - 1, 0)]), 1.0)  # P(grade >= y)
        lower = np.where(y < k, sigmoid(score - t[np.minimum(y, k - 1)]), 0.0)  # P(grade > y)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = -(du - dl) * weight
        d_t = np.bincount(np.maximum(y - 1, 0), du * weight * (y > 0), minlength=k) - np.bincount(np.minimum(y, k - 1), dl * weight * (y < k), minlength=k)
        steps_up = np.exp(np.clip(x[rows.size + 1 :], -10, 5))
        tail = np.cumsum(d_t[::-1])[::-1]
        return np.concatenate([rows.t_dot(d_score) + l2 * w, [d_t.sum()], tail[1:] * steps_up])

    start = np.zeros(rows.size + k)
    return OrdinalModel(*unpack(adam(gradient, start, steps))) if len(y) else OrdinalModel(np.zeros(rows.size), np.full(k, -20.0))


def train_quality(docs: DataFrame, labels: DataFrame, grade: str, n_grades: int, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``max_rows`` rated documents; ``grade`` is an SQL expression over labels.

    Without any rating the model keeps everything at the highest grade.
    """
    graded = labels.select(labels[id_col].alias("id"), F.expr(grade).cast("int").alias("grade")).where(f"grade between 0 and {n_grades - 1}")
    sample = labelled_sample(docs, graded.withColumnRenamed("id", id_col), ["grade"], max_rows, id_col, text_col).select("body", "y0", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary()), batch.column(2).cast(pa.string())], ["grade", "i", "v", "id"])

    found = map_batches(sample, run, "grade int, i binary, v binary, id string").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["i"])))
    rows = Rows([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4")) for r in found], SIZE)
    return fit_ordinal(rows, np.array([r["grade"] for r in found]), n_grades)


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = KEEP_GRADE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """Per row ``id_col, expected_grade, tail, kept``: the expected grade, P(grade >= keep_grade).

    Every whole text is scored; a null text is empty and scored as such. Rows are independent,
    so repeats, ties, null ids and further columns do not matter; no rows in, none out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.weights
        for batch in batches:
            scores = []
            for text in batch.column(1):
                index, value = features(text.as_py() or "")
                scores.append(float(value @ w[index]))
            tails = held.value.tails(np.array(scores, dtype=float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, keep_grade - 1])], [id_col, "expected_grade", "tail"])
        _forget()

    scored = map_batches(docs.select(docs[id_col], docs[text_col].cast("string")), run, f"`{id_col}` {id_type}, expected_grade double, tail double")
    return scored.withColumn("kept", F.col("tail") >= keep_tail)


def selected(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_grade: int = KEEP_GRADE, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The rows whose tail probability reaches ``keep_tail``; columns and rows as given."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.weights
        for batch in batches:
            scores = []
            for text in batch.column(at):
                index, value = features(text.as_py() or "")
                scores.append(float(value @ w[index]))
            keep = held.value.tails(np.array(scores, dtype=float))[:, keep_grade - 1] >= keep_tail
            yield batch.filter(pa.array(keep, pa.bool_()))
        _forget()

    return map_batches(docs, run, docs.schema)
