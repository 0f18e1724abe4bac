import random

import corpus_pipeline
from textloom.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "kan lor mir tes vul pon gar bel".split() for b in "do ra li mo ne tu".split()]
    prose = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    good = [prose(60) for _ in range(40)]
    poor = [" ".join(w.upper() + "!!" for w in prose(50).split()) for _ in range(20)]
    item = prose(30)
    near = good[0].split()
    near[10] = "changed"
    texts = good + poor + [good[1], " ".join(near), prose(20) + " " + item, good[2].replace(" ", "\n", 1)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]
    left = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
        counts.append(left.count())
    assert counts == [44, 42, 41, 40]
    out = queries.QUERIES["pipeline"](spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40)) and out.where("not decoded_ok").isEmpty()


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names, and empty tables."""
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh  .") for _ in range(300_000))
    texts = [None, "", " ", "a", "a", "a", long, long + " x", "Tom has 3 apples.", "Tom has 3 apples."]
    rows = [(k // 2 if k else None, t, None, None, None, "id", 1, "g0") for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, node int, words string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5)] + [(None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "What is the capital city of the country that lies north of here?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = {"quality": 10, "exact_dedup": 6, "near_dedup": 6, "decontaminate": 10, "encode": 10}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == expected[name], name
        assert name == "encode" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).count() == 5
