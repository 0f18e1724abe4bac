"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees see an URL's lengths, depth, digit ratio, entropy, parameter counts and, for its
host's suffixes, how often labelled URLs with that suffix are blocked. They are fitted on a
bounded sample of labelled URLs and applied to every URL.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches

MAX_ROWS, TREES, DEPTH, BINS, RATE, BLOCK_AT = 5_000, 40, 4, 32, 0.2, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "suffix1_rate", "suffix1_count", "suffix2_rate", "suffix2_count", "host_rate", "host_count")


class Rule(NamedTuple):
    """A host with a path prefix, such as ``example.com/en/``, and the verdict it gives."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        head, slash, rest = self.rule.partition("/")
        return slash + rest


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits the host or a parent of it and begins the path; null if none."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.rule)).otherwise(out)
    return out


def _suffixes(host: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), host


def lexical(url: str) -> list[float]:
    """The features that need the URL only."""
    _, found, rest = url.partition("://")
    rest = rest if found else url
    cut = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    tail, _, fragment = tail.partition("#")
    path, _, query = tail.partition("?")
    n = max(1, len(url))
    counts = Counter(url).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    return [len(url), len(host), len(path), len(query), sum(bool(p) for p in path.split("/")), host.count(".") + 1, sum(c.isdigit() for c in url) / n, entropy, query.count("&") + bool(query), url.count("-"), bool(fragment)]


def _host(url: str) -> str:
    _, found, rest = url.partition("://")
    if not found:
        return ""
    cut = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    return rest[:cut].lower()


class SuffixStatistics(NamedTuple):
    """Blocked and all labelled URLs of each suffix, and the overall share."""

    blocked: dict[str, int]
    total: dict[str, int]
    share: float

    def of(self, url: str, own: int | None = None) -> list[float]:
        """Smoothed rate and log count for three suffixes; with ``own``, without this URL's label."""
        out = []
        for s in _suffixes(_host(url)):
            n, b = self.total.get(s, 0), self.blocked.get(s, 0)
            if own is not None:
                n, b = n - 1, b - own
            out += [(b + 4 * self.share) / (n + 4), math.log1p(max(n, 0))]
        return out


def suffix_statistics(urls: list[str], y: list[int]) -> SuffixStatistics:
    blocked: Counter = Counter()
    total: Counter = Counter()
    for url, label in zip(urls, y):
        for s in set(_suffixes(_host(url))):
            total[s] += 1
            blocked[s] += label
    return SuffixStatistics(dict(blocked), dict(total), sum(y) / len(y) if y else 0.0)


class Tree(NamedTuple):
    """A complete binary tree by levels: feature and bound of inner nodes, values of leaves."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(int(math.log2(len(self.value)))):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.bound[node])
        return self.value[node - len(self.feature)]


class Boosted(NamedTuple):
    """Base score, trees, and the suffix statistics that the features need."""

    base: float
    trees: list[Tree]
    suffixes: SuffixStatistics

    def probability(self, urls: list[str]) -> np.ndarray:
        """P(block) of each URL."""
        if not urls:
            return np.zeros(0)
        x = np.array([lexical(u) + self.suffixes.of(u) for u in urls], dtype=float)
        score = self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def _grow(x: np.ndarray, binned: np.ndarray, bounds: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float = 1.0) -> Tree:
    """One regression tree on gradients, by histograms, level by level."""
    inner = 2**depth - 1
    feature, bound = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), dtype=np.int64)
    width = binned.max() + 1 if binned.size else 1
    for level in range(depth):
        first, many = 2**level - 1, 2**level
        local = node - first
        best, pick = np.full(many, 1e-6), np.full((many, 2), -1)
        for f in range(x.shape[1]):
            cell = local * width + binned[:, f]
            hg = np.bincount(cell, g, minlength=many * width).reshape(many, width).cumsum(axis=1)
            hh = np.bincount(cell, h, minlength=many * width).reshape(many, width).cumsum(axis=1)
            sg, sh = hg[:, -1:], hh[:, -1:]
            gain = hg**2 / (hh + ridge) + (sg - hg) ** 2 / (sh - hh + ridge) - sg**2 / (sh + ridge)
            gain = gain[:, : len(bounds[f])]
            if gain.shape[1]:
                k = gain.argmax(axis=1)
                top = gain[np.arange(many), k]
                better = top > best
                best[better] = top[better]
                pick[better] = np.stack([np.full(many, f), k], axis=1)[better]
        for j in range(many):
            f, k = pick[j]
            if f >= 0:
                feature[first + j], bound[first + j] = f, bounds[f][k]
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > bound[node])
    leaf = node - inner
    sg, sh = np.bincount(leaf, g, minlength=inner + 1), np.bincount(leaf, h, minlength=inner + 1)
    return Tree(feature, bound, -rate * sg / (sh + ridge))


def fit_boosted(urls: list[str], y: list[int], trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, stats: SuffixStatistics | None = None) -> Boosted:
    """Logistic gradient boosting; without both labels, a constant (allow if there are none).

    ``stats`` are those of all labelled URLs, these among them; without them, of these URLs.
    """
    stats = stats or suffix_statistics(urls, y)
    if not y or sum(y) in (0, len(y)):
        return Boosted(10.0 if y and sum(y) else -10.0, [], stats)
    x = np.array([lexical(u) + stats.of(u, own) for u, own in zip(urls, y)], dtype=float)
    target = np.array(y, dtype=float)
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1)
    base = math.log(target.mean() / (1 - target.mean()))
    score, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, binned, bounds, p - target, p * (1 - p), depth, rate)
        score += tree.predict(x)
        grown.append(tree)
    return Boosted(base, grown, stats)


def all_suffix_statistics(rows: DataFrame) -> SuffixStatistics:
    """Statistics of all labelled URLs ``u, y``, counted on the executors; null stands for all URLs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [int(v > 0) for v in batch.column(1).to_pylist()]
            part = suffix_statistics(batch.column(0).to_pylist(), y)
            names = [None, *part.total]
            columns = [pa.array(names, pa.string()), pa.array([len(y), *part.total.values()], pa.int64()), pa.array([sum(y), *(part.blocked[s] for s in part.total)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["suffix", "total", "blocked"])

    counted = map_batches(rows.select("u", "y"), run, "suffix string, total long, blocked long").groupBy("suffix").agg(F.sum("total").alias("total"), F.sum("blocked").alias("blocked")).collect()
    share = next((r["blocked"] / r["total"] for r in counted if r["suffix"] is None and r["total"]), 0.0)
    known = [r for r in counted if r["suffix"] is not None]
    return SuffixStatistics({r["suffix"]: r["blocked"] for r in known}, {r["suffix"]: r["total"] for r in known}, share)


def train_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", max_rows: int = MAX_ROWS) -> Boosted:
    """Suffix statistics of all labelled URLs; trees fitted on at most ``max_rows``, chosen by a hash, the same ones at each run."""
    rows = labelled.select(labelled[url_col].alias("u"), labelled[label_col].cast("int").alias("y")).where("u is not null and y is not null").distinct()
    found = rows.orderBy(F.xxhash64("u", "y"), "u", "y").limit(max_rows).collect()
    return fit_boosted([r["u"] for r in found], [int(r["y"] > 0) for r in found], stats=all_suffix_statistics(rows))


def judge_urls(pages: DataFrame, rules: list[Rule], model: Boosted, id_col: str = "page_id", url_col: str = "url", block_at: float = BLOCK_AT) -> DataFrame:
    """Per row ``id_col, host, path, rule, verdict, block_probability``.

    The longest fitting rule decides; without one the trees do, which allow a URL that is null
    or has no ``://``. Rows are independent: repeats, ties, null ids and further columns do not
    matter. ``rules`` is a short list that becomes part of the plan.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    id_type = pages.schema[id_col].dataType.simpleString()
    verdict_of = {r.rule: r.verdict for r in rules}
    known = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    known = known.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, ruled = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            p = held.value.probability(urls)
            verdicts = [verdict_of[r] if r is not None else ("block" if q >= block_at and "://" in u else "allow") for r, q, u in zip(ruled, p, urls)]
            columns = [batch.column(0), *batch.columns[2:5], pa.array(verdicts, pa.string()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "host", "path", "rule", "verdict", "block_probability"])

    return map_batches(known, run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, block_probability double")


def rule_labels(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """URLs that a rule decides, labelled by it: ``url, blocked``."""
    verdict = matching_rule(host_of(pages[url_col]), path_of(pages[url_col]), rules)
    blocking = [r.rule for r in rules if r.verdict == "block"]
    return pages.select(pages[url_col].alias("url"), verdict.alias("rule")).where("rule is not null").select("url", F.col("rule").isin(blocking).cast("int").alias("blocked"))
