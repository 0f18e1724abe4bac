"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the text's hashed words and the
probabilities of the categories before it. While training, those probabilities are out-of-fold
predictions, so later models learn from what earlier ones are worth on unseen texts.

Categories are columns of the ratings. Where the ratings only say whether a text is toxic as a
whole, categories are facets found in the rated texts: the words that tell toxic texts from
others most surely are put together by the texts they share, and a toxic text has a facet if it
has one of its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches
from textloom.llm.hashed_linear import Rows, accelerated, labelled_sample, largest_eigenvalue, sigmoid

SIZE, MAX_ROWS, FOLDS, THRESHOLD = 1 << 18, 4_000, 3, 0.65
MIN_DF, PREFIXES = 8, (5, 7)
#: Facets looked for where there are no category ratings, words that may mark them, and how sure these must be (standard errors).
FACETS, MARKERS, SURE = 3, 30, 4.0
#: Log odds under which a word's feature is left out of a model.
LEAST_ODDS = 0.15
_WORDS = re.compile(r"\w+").findall


class _Index(dict):
    """Words to the hashed indices of the word and its first letters; bounded."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 100_000:
            self.clear()
        names = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
        self[word] = found = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % SIZE for x in names)
        return found


_INDEX = _Index()


def features(text: str) -> np.ndarray:
    """Sorted hashed indices of the distinct lower-cased words, and word beginnings, of a whole text."""
    return np.unique(np.fromiter(chain.from_iterable(map(_INDEX.__getitem__, set(_WORDS(text.lower())))), dtype=np.int64))


class Chain(NamedTuple):
    """Per category: word weights, weights of the earlier probabilities, bias; and the categories' names."""

    words: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    names: tuple[str, ...] = ()

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities, one column for each category, each fed to the next."""
        out = np.zeros((rows.n, len(self.bias)))
        for c in range(len(self.bias)):
            out[:, c] = sigmoid(rows.dot(self.words[c]) + out[:, :c] @ self.earlier[c, :c] + self.bias[c])
        return out


def _fit_one(rows: Rows, before: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression, both classes of equal weight in all.

    Words in fewer than ``MIN_DF`` texts or of small log odds between the classes are left out,
    and each word's feature is scaled by its log odds, so that fitting spends its weight on words
    that tell.
    """
    positives = y.sum()
    k = before.shape[1]
    words = np.zeros(rows.size)
    if positives in (0, len(y)):
        return words, np.zeros(k), 8.0 if positives else -8.0
    seen = np.bincount(rows.index, minlength=rows.size)
    used = np.flatnonzero(seen >= MIN_DF)
    own = np.bincount(rows.index, y[rows.at], minlength=rows.size)[used]
    scale = np.log((own + 1) / (positives + 2)) - np.log((seen[used] - own + 1) / (len(y) - positives + 2))
    used, scale = used[np.abs(scale) >= LEAST_ODDS], scale[np.abs(scale) >= LEAST_ODDS]
    place = np.full(rows.size, -1)
    place[used] = np.arange(len(used))
    m = place[rows.index] >= 0
    at, index = rows.at[m], place[rows.index[m]]
    value = scale[index]
    weight = np.where(y > 0, 0.5 / positives, 0.5 / (len(y) - positives))
    n, u = len(y), len(used)

    def dot(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, value * x[index], minlength=n) + before @ x[u : u + k] + x[-1]

    def t_dot(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(index, value * r[at], minlength=u), before.T @ r, [r.sum()]])

    ridge = np.concatenate([np.full(u + k, l2), [0.0]])
    curvature = 0.26 * largest_eigenvalue(lambda v: t_dot(weight * dot(v)), u + k + 1) + l2
    x = accelerated(lambda x: t_dot((sigmoid(dot(x)) - y) * weight) + ridge * x, np.zeros(u + k + 1), curvature, steps)
    words[used] = x[:u] * scale
    return words, x[u : u + k], float(x[-1])


def facets(rows: Rows, toxic: np.ndarray, most: int = FACETS) -> np.ndarray:
    """0/1 per row and facet: toxic rows' facets, found from the words that mark toxic rows.

    Markers are the features whose log odds are surest. The first facet grows from the marker
    of most toxic rows, each further one from the marker of most rows that no facet has yet;
    other markers join the facet whose first marker shares most of their rows.
    """
    y = toxic > 0
    out = np.zeros((rows.n, most))
    if not y.any() or y.all():
        return out
    n1, n0 = y.sum(), (~y).sum()
    own = np.bincount(rows.index, y[rows.at].astype(float), minlength=rows.size)
    rest = np.bincount(rows.index, minlength=rows.size) - own
    odds = np.log((own + 0.5) / (n1 - own + 0.5)) - np.log((rest + 0.5) / (n0 - rest + 0.5))
    error = np.sqrt(1 / (own + 0.5) + 1 / (n1 - own + 0.5) + 1 / (rest + 0.5) + 1 / (n0 - rest + 0.5))
    sure = odds / error
    markers = np.lexsort((np.arange(rows.size), -sure))[:MARKERS]
    markers = markers[(sure[markers] >= SURE) & (own[markers] > rest[markers])]
    has = np.zeros((rows.n, len(markers)), dtype=bool)
    for k, word in enumerate(markers):
        has[rows.at[rows.index == word], k] = True
    has &= y[:, None]
    covered, firsts = np.zeros(rows.n, dtype=bool), []
    while len(firsts) < most and len(firsts) < len(markers):
        gain = (has & ~covered[:, None]).sum(axis=0)
        if gain.max() == 0:
            break
        firsts.append(int(gain.argmax()))
        covered |= has[:, firsts[-1]]
    for k in range(len(markers)):
        shared = [(has[:, k] & has[:, f]).sum() / max(1, (has[:, k] | has[:, f]).sum()) for f in firsts]
        if shared:
            out[has[:, k], int(np.argmax(shared))] = 1
    return out


def fit_chain(rows: Rows, labels: np.ndarray, folds: int = FOLDS, l2: float = 1e-4, steps: int = 120, names: tuple[str, ...] = ()) -> Chain:
    """Fit the chain; ``labels`` has a column for each category, rows are dealt to folds in turn."""
    n, k = labels.shape
    if not n:
        return Chain(np.zeros((k, rows.size)), np.zeros((k, k)), np.full(k, -8.0), names)
    fold = np.arange(n) % folds
    unseen = np.zeros((n, k))
    words, earlier, bias = np.zeros((k, rows.size)), np.zeros((k, k)), np.zeros(k)
    for c in range(k):
        y = labels[:, c].astype(float)
        words[c], earlier[c, :c], bias[c] = _fit_one(rows, unseen[:, :c], y, l2, steps)
        if c + 1 < k:
            for f in range(folds):
                out = fold == f
                if out.any() and not out.all():
                    w, e, b = _fit_one(rows.take(~out), unseen[~out][:, :c], y[~out], l2, steps)
                    unseen[out, c] = sigmoid(rows.take(out).dot(w) + unseen[out][:, :c] @ e + b)
    return Chain(words, earlier, bias, names)


def train_toxicity(docs: DataFrame, labels: DataFrame, toxic_col: str = "toxic", category_cols: tuple[str, ...] = (), max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most ``max_rows`` rated documents; without ratings nothing is toxic.

    ``category_cols`` are 0/1 ratings of categories, in the chain's order; ``toxic_col`` rates the
    whole and comes last. Without category ratings the categories are facets of the rated texts.
    Of several ratings or texts of an id the smallest counts.
    """
    cols = [*category_cols, toxic_col]
    rated = labelled_sample(docs, labels, cols, max_rows, id_col, text_col)
    sample = rated.select("body", F.array(*[(F.col(f"y{k}").cast("int") > 0).cast("int") for k in range(len(cols))]).alias("y"), F.col("id").cast("string").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = [features(text.as_py()).astype("<i4").tobytes() for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(index, pa.binary()), batch.column(1)], ["id", "i", "y"])
        _INDEX.clear()

    found = sorted(map_batches(sample, run, "id string, i binary, y array<int>").collect(), key=lambda r: (r["id"], bytes(r["i"])))
    rows = Rows([(np.frombuffer(r["i"], "<i4"), np.ones(len(r["i"]) // 4)) for r in found], SIZE)
    y = np.array([r["y"] for r in found], dtype=float).reshape(len(found), len(cols))
    if category_cols:
        return fit_chain(rows, y, names=tuple(cols))
    made = facets(rows, y[:, 0])
    return fit_chain(rows, np.column_stack([made, y]), names=(*(f"facet_{k + 1}" for k in range(made.shape[1])), toxic_col))


def score_toxicity(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``id_col``, ``p_<category>`` for each category, and ``toxic``.

    The last category decides. Whole texts are scored; a null text is empty. Rows are
    independent: repeats, ties, null ids and further columns do not matter.
    """
    nonzero = np.flatnonzero(model.words.any(axis=0)).astype(np.int32)
    held = docs.sparkSession.sparkContext.broadcast((nonzero, model.words[:, nonzero].astype(np.float32), model.earlier, model.bias, model.names))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f"p_{c}" for c in model.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, earlier, bias, _ = held.value
        words = np.zeros((len(bias), SIZE), dtype=np.float32)
        words[:, at] = values
        full = Chain(words, earlier, bias)
        for batch in batches:
            made = [features(t.as_py() or "") for t in batch.column(1)]
            p = full.predict(Rows([(i, np.ones(len(i))) for i in made], SIZE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(bias)))], [id_col, *names])
        _INDEX.clear()

    scored = map_batches(docs.select(docs[id_col], docs[text_col].cast("string")), run, f"`{id_col}` {id_type}, " + ", ".join(f"{n} double" for n in names))
    return scored.withColumn("toxic", F.col(names[-1]) >= threshold)
