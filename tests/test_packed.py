"""The packed index of the semantic search against the index of rows, numpy and the column functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.folds import Folded, letters, words
from textloom.functions.tokens import engine_tokens, plain_words, trigram_set
from textloom.operators import packed, search, semantic

ODD = ["", None, "İSTANBUL'da ÇOK güzel, straße æther ﬁne 한국어 ...", "Kelvin ΣΑΣ x y\x1cz ≠ ;", "don't-stop ____ a_b", "kitaplar kitapların evlerinden " * 3]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    pool = [f"{t}{k}wort" for t in ("alpha", "beta", "gamma") for k in range(12)]
    docs = [(k, " ".join(rng.choice(pool[12 * (k % 3) : 12 * (k % 3) + 12] if rng.random() < 0.9 else pool) for _ in range(30))) for k in range(60)]
    rows = docs + [(100 + k, t) for k, t in enumerate(ODD)] + [(3, "alpha1wort beta2wort"), (None, "gamma3wort")]
    return spark.createDataFrame(rows, "id long, text string").withColumn("title", F.substring("text", 1, 20)).repartition(3)


def test_python_words_are_those_of_columns(spark):
    rows = spark.createDataFrame([(t or "",) for t in ODD], "t string").select("t", F.lower("t").alias("low"), plain_words(F.col("t")).alias("w"), trigram_set(F.col("t")).alias("g")).collect()
    for r in rows:
        assert words(r["low"], Folded()) == r["w"]
        t = letters(r["t"], Folded())
        assert {t[k : k + 3] for k in range(len(t) - 2)} == set(r["g"])


def test_packed_index_is_the_index(spark, texts):
    whole = search.build_index(texts, "id", "text", "title", engine_tokens)
    made = packed.build(texts, "id", "text", "title")
    got = packed.lookup(made, whole.terms)
    rows = lambda f: sorted(map(tuple, f.collect()), key=str)
    assert (got.n, got.avgdl) == (whole.n, pytest.approx(whole.avgdl))
    assert rows(got.postings.where("doc is not null").select("doc", "term", "tf")) == rows(whole.postings.where("doc is not null").select("doc", "term", "tf"))
    assert rows(got.terms.select("term", "df")) == rows(whole.terms.select("term", "df"))
    asked = search.query_terms(texts.where("id < 5"), "id", "text", engine_tokens)
    few = packed.lookup(made, asked)
    for score, name in ((search.tfidf, "lex"), (search.bm25, "bm25")):
        a, b = ({(r["q"], r["doc"]): r[name] for r in score(x, asked).collect()} for x in (whole, few))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_packed_spaces(spark, texts):
    made = packed.build(texts.where("id < 60 and id <> 3"), "id", "text")
    index = search.build_index(texts.where("id < 60 and id <> 3"), "id", "text", None, engine_tokens)
    post = index.postings.join(index.terms.where("df >= 5 and length(term) >= 3"), "term").collect()
    docs, terms = sorted({r["doc"] for r in post}), sorted({r["term"] for r in post})
    a = np.zeros((len(docs), len(terms)))
    for r in post:
        a[docs.index(r["doc"]), terms.index(r["term"])] = (1 + np.log(r["tf"])) * r["idf"]
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    for k in (200, 3):
        vec, basis = packed.lsa(made, index.terms, k=k, rounds=6)
        got = np.array([r["v"] for r in vec.orderBy("doc").collect()])
        kept = u[:, :k] * s[:k]
        kept /= np.linalg.norm(kept, axis=1, keepdims=True)
        assert np.abs(got @ got.T - kept @ kept.T).max() < 1e-4 and basis.count() == len(terms)
    old, new = (f.orderBy("term").collect() for f in (semantic.ppmi_vectors(semantic.ppmi(index), 500), packed.word_vectors(made, 500)))
    x, y = (np.array([r["v"] for r in f]) for f in (old, new))
    assert [r["term"] for r in old] == [r["term"] for r in new] and np.abs(x @ x.T - y @ y.T).max() < 1e-6


def test_largest_eigenvalues():
    m = np.random.default_rng(3).standard_normal((400, 400))
    m += m.T
    values, vectors = packed.largest(m, 10)
    want = np.linalg.eigvalsh(m)
    assert np.abs(values) == pytest.approx(np.sort(np.abs(want))[::-1][:10]) and np.abs(m @ vectors - vectors * values).max() < 1e-6
