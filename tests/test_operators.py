import json
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import dedupe, merge, metrics, pairs, routing, sampling, search, semantic, subwords
from textloom.storage import materialise, release


def naive_dedupe(rows, threshold):
    kept, out = [], {}
    for ord_, ctx, resp in rows:
        words = set(ctx.split())
        if any(r == resp for _, r in kept):
            out[ord_] = "response"
        elif not words:
            out[ord_] = "empty"
        elif any(len(words & w) / len(words | w) >= threshold for w, _ in kept):
            out[ord_] = "similar"
        else:
            kept.append((words, resp))
            out[ord_] = None
    return out


def test_dedupe_is_the_sequential_pass(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(120):
        ctx = rng.sample(words, rng.randint(0, 9)) if k < 40 or rng.random() < 0.4 else None
        if ctx is None:
            ctx = rows[rng.randrange(len(rows))][1].split()
            if ctx and rng.random() < 0.7:
                ctx[rng.randrange(len(ctx))] = rng.choice(words)
        rows.append((k, " ".join(ctx), f"r{rng.randrange(80)}"))
    frame = spark.createDataFrame(rows, "ord int, ctx string, resp string").repartition(7)
    got = {r["ord"]: r["reason"] for r in dedupe.dedupe_pairs(frame, threshold=0.6).collect()}
    assert got == naive_dedupe(rows, 0.6)


def test_chat_pairs(spark):
    turns = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "old"), (1, 3, "human", "q2"), (1, 4, "gpt", " a2 "), (1, 5, "gpt", "extra"), (2, 0, "assistant", "x"), (2, 1, "user", " "), (2, 2, "user", None)]
    got = pairs.chat_pairs(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert [(r["ctx"], r["resp"]) for r in got] == [("q1", "a1"), ("q2", "a2")]


def test_intent_pairs(spark):
    pats = [f"soru metni {w}" for w in "abcdef"]
    rows = [(0, "bilgi_konu", pats, ["birinci uzun cevap", "ikinci uzun cevap"], None), (1, "sohbet_konu", [p + "x" for p in pats], ["selam sana dostum", "nasilsin bugun"], "sohbet")]
    got = pairs.intent_pairs(spark.createDataFrame(rows, "ord int, tag string, patterns array<string>, responses array<string>, kind string"))
    assert got.where("ord = 0").count() == 12 and got.where("ord = 1").count() == 6


def test_encode(spark):
    row = spark.createDataFrame([([7, 8], [9])], "a array<int>, b array<int>").select(*pairs.encode_pair(F.col("a"), F.col("b"))).first()
    assert row[0] == [1, 7, 8, 3, 9, 2] and row[1] == [0, 0, 0, 1, 1, 0]


def test_verses_and_prose(spark):
    poem = "<poem>" + "\n".join(f"bu uzun bir dize satiri {k}" for k in "abcd") + "</poem>"
    assert pairs.verse_pairs(spark.createDataFrame([(1, poem)], "i int, t string"), "i", "t").count() == 2
    prose = " ".join(f"Bu cumle numara {k} olarak yazildi." for k in range(8))
    got = pairs.prose_pairs(spark.createDataFrame([(1, prose), (2, "Tek cumle var.")], "i int, t string"), "i", "t").collect()
    assert len(got) == 1 and got[0]["resp"].startswith("bu cumle numara 4")


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "key string, ord int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 2, "w")], "key string, ord int, v string")
    got = merge.keyed_merge(old, new, "key", "ord").orderBy("place").collect()
    assert [(r["key"], r["v"], r["added"]) for r in got] == [("a", "z", False), ("b", "y", False), ("c", "w", True)]
    assert [r["key"] for r in merge.keyed_merge(old, new, "key", "ord", keep=2).orderBy("place").collect()] == ["b", "c"]
    assert tuple(merge.merge_counts(old, new, "key").first()) == (1, 1)
    lists = spark.createDataFrame([("t", 0, ["a", "b"]), ("t", 1, ["b", "c"])], "k string, o int, xs array<string>")
    assert merge.merge_lists(lists, "k", "o", ["xs"]).first()["xs"] == ["a", "b", "c"]


def test_guards(spark, tmp_path):
    rows = spark.range(100)
    with pytest.raises(ValueError):
        merge.guarded_overwrite(rows, rows.limit(2), str(tmp_path / "x"))
    assert merge.guarded_overwrite(rows, rows.limit(98), str(tmp_path / "x")) == pytest.approx(0.02)
    assert not merge.write_nonempty(rows.limit(0), str(tmp_path / "y")) and not (tmp_path / "y").exists()


def test_metrics(spark):
    same = "the cat sat on the mat today"
    rows = [(1, "q cat", same, same), (2, "q cat", same, ""), (3, "q cat", same, "wholly other words here now")]
    m = {r["k"]: r for r in metrics.measure(spark.createDataFrame(rows, "k int, query string, gold string, generated string")).collect()}
    assert m[1]["copy_bleu"] == pytest.approx(1.0) and m[2]["copy_bleu"] == 0 and m[3]["copy_bleu"] == 0
    assert m[1]["qa_score"] > 0.85 > m[3]["qa_score"] > m[2]["qa_score"] == pytest.approx(0.25 * 0.5 - 0.5)
    with pytest.raises(ValueError):
        metrics.compare_reports(None, None, {"metric_version": 2}, {"metric_version": 3})


def test_early_stop(spark):
    losses = [(2, 1.0), (4, 0.5), (6, 0.6), (8, 0.7), (10, 0.8), (12, 0.1)]
    row = metrics.early_stop(spark.createDataFrame(losses, "e int, l double"), "e", "l", patience=6, val_every=2).first()
    assert (row["best_epoch"], row["stop_epoch"]) == (4, 10)


def test_rag_stats(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "knowledge string")
    assert tuple(metrics.rag_context_stats(rows).first()) == (3, 2, 5)


def test_sampling(spark):
    rows = spark.createDataFrame([(k, k % 3 == 0) for k in range(30)], "k int, y boolean")
    got = sampling.balanced(rows, "y", "k", 100).groupBy("y").count().collect()
    assert {r["count"] for r in got} == {10}
    with pytest.raises(ValueError):
        sampling.balanced(rows.where("y"), "y", "k", 10)
    p = spark.createDataFrame([(f"c{k % 7}", f"r{k}") for k in range(40)], "ctx string, resp string")
    assert sampling.coverage_first(p, "ctx", "resp", 9).select("ctx").distinct().count() == 7
    split = sampling.group_split(p, "ctx")
    assert split.groupBy("ctx").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    a = sampling.fingerprint(rows, "k", ["y"]).first()[0]
    assert a == sampling.fingerprint(rows.repartition(5), "k", ["y"]).first()[0] != sampling.fingerprint(rows.where("k <> 3"), "k", ["y"]).first()[0]
    assert sampling.data_budget_pairs(16225, 256_333) == 256_333


def test_search_chain(spark):
    docs = [(0, "Akil", "akil insanin dusunme gucudur"), (1, "Klorofil", "bitkilerde klorofil yesil renk verir"), (2, "Deniz", "deniz tuzlu su kutlesidir")]
    index = search.build_index(spark.createDataFrame(docs, "id int, title string, text string"), "id", "text", "title")
    q = spark.createDataFrame([(1, "klorofil nedir"), (2, "akil"), (3, "zzzz qqqq")], "q int, t string")
    got = {r["q"]: r["doc"] for r in search.search(index, q, "q", "t").collect()}
    assert got == {1: 1, 2: 0}
    hit = search.pattern_hits(q.select("q", F.split("t", " ").alias("w")), "w", spark.createDataFrame([(5, ["klorofil", "nedir", "ki"])], "doc int, w array<string>"), "w")
    assert [(r["q"], r["doc"]) for r in hit.collect()] == [(1, 5)]


def test_semantic_spaces(spark):
    docs = [(k, "kedi balik sever kedi" if k % 2 else "araba yolda hizli gider") for k in range(8)]
    index = search.build_index(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    vec, basis = semantic.lsa(index, k=4, least=2)
    rows = {r["doc"]: r["v"] for r in vec.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert dot(rows[1], rows[3]) == pytest.approx(1.0, abs=1e-6) or dot(rows[1], rows[3]) == 0
    assert abs(dot(rows[0], rows[1])) < 1e-6
    assert semantic.ppmi(index, least=2).where("ppmi > 0 and a = 'kedi'").count() >= 1


def test_routing(spark):
    intents = spark.createDataFrame([("a", ["Selam!"], False), ("b", ["selam"], True), ("c", ["tek"], True), ("d", ["tek"], True)], "tag string, patterns array<string>, knowledge boolean")
    index = {r["key"]: r["tag"] for r in routing.pattern_index(intents).collect()}
    assert index == {"selam": "a", "tek": None}
    kw = spark.createDataFrame([("x", "kedi"), ("y", "kopek"), ("z", "araba"), ("x", "hayvan"), ("y", "hayvan")], "tag string, stem string")
    scores = routing.attention(spark.createDataFrame([(1, "kedi")], "q int, stem string"), kw, routing.keyword_weights(kw))
    assert routing.top_tag(scores, kw.select("tag").distinct().withColumn("rank", F.lit(1))).first()["tag"] == "x"


def test_bpe(spark):
    merges = subwords.train_merges({"merhaba": 20}, 200, sorted("merhab"))
    assert subwords.encode_word("merhaba", {p: k for k, p in enumerate(merges)}) == ["merhaba"]
    docs = spark.createDataFrame([(1, "merhaba dunya"), (2, "")], "i int, t string")
    got = {r["id"]: r["pieces"] for r in subwords.encode_texts(docs, "i", "t", merges).collect()}
    assert got[1][0] == "merhaba" and "".join(got[1]) == "merhabadunya" and got[2] == ["[pad]"]


def test_scratch_tables(spark):
    df = materialise(spark.range(5), "probe")
    assert df.count() == 5 and release(spark) >= 1


def test_registered_queries_have_columns(spark):
    import __spark_entry__ as entry

    sql = entry.oracle_sql()
    assert set(sql) <= set(entry.queries()) and len(sql) > 40
    assert entry.entry(spark).limit(1).count() == 1
    assert json.dumps(sorted(sql))


def test_documents_are_compared_by_their_whole_first_line(spark, tmp_path):
    from textloom.plans.pair_queries import dedupe_documents

    head = " ".join(f"word{k}" for k in range(60))
    first = [f"{head} {' '.join(f'{c}{k}' for k in range(60))}" for c in "ab"]
    texts = [f"{first[0]}\nx", f"{first[1]}\ny", f"\n {first[0]}\nz", "short\nlines follow", "short\nother lines"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["ord"]: r["reason"] for r in dedupe_documents(spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: "similar", 3: None, 4: "similar"}


def test_merges_are_learned_from_all_words(spark, tmp_path):
    from textloom.plans.retrieval_queries import bpe_pieces

    names = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrs" for b in "abcdefghijklmnopqrs" for c in "abcdefghijklmnopqrs"]
    # the pair x, y is in rare words only, each of them once
    text = " ".join(names[:5200] * 2 + [f"xy{n}" for n in names[:6000]])
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "xy")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["pieces"] for r in bpe_pieces(spark, str(tmp_path)).collect()] == ["xy"]


def test_merges_of_words_that_stay_on_the_executors(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(12)]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 8))): rng.randint(1, 40) for _ in range(300)} | {"aaaaaaa": 50}
    want = subwords.train_merges(words, 4 + 70, [], 2)
    docs = spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()], "t string").repartition(3)
    monkeypatch.setattr(subwords, "train_merges", None)  # it takes the words on the driver
    monkeypatch.setattr(subwords, "HELD_MERGES", 9)
    assert subwords.train_bpe(docs, "t", 4 + 70, [], 2, max_words=None) == want


def test_terms_that_stand_together_are_no_rows(spark):
    docs = [(k, " ".join(f"term{(k * j) % 23}" for j in range(1, 9))) for k in range(30)]
    index = search.build_index(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    kept = {w for w in (f"term{j}" for j in range(23)) if sum(w in t.split() for _, t in docs) >= 3}
    sets = [kept & set(t.split()) for _, t in docs]
    n = {(a, b): sum(a in s and b in s for s in sets) for a in kept for b in kept if a != b}
    margin = {a: sum(v for (x, _), v in n.items() if x == a) for a in kept}
    got = semantic.ppmi(index)
    assert semantic._together(index.postings, sorted(kept)).count() == len(n) - sum(not v for v in n.values())
    want = {p: max(0.0, math.log(sum(n.values()) * v / (margin[p[0]] * margin[p[1]]))) for p, v in n.items() if v}
    assert {(r["a"], r["b"]): r["ppmi"] for r in got.collect()} == pytest.approx(want)



def test_matched_responses_are_those_of_all_pairs(spark):
    from textloom.functions.tokens import ascii_tokens
    from textloom.operators import generators

    rng = random.Random(3)
    words = ["kedi", "kediler", "balik", "a1b", "su", "için", "deniz", "denizler", "ler"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    docs = spark.createDataFrame([(rng.choice(["x", "y", None]), say(6)) for _ in range(80)] + [("x", None)], "lang string, response string").repartition(3)
    q = spark.createDataFrame([(k, rng.choice(["x", "y", "z"]), say(4)) for k in range(25)], "i int, lang string, text string")
    got = generators.matched_responses(q, "i", "text", docs, "response", "lang")
    both = q.join(docs, "lang").withColumns({"w": ascii_tokens(F.col("text")), "t": ascii_tokens(F.col("response"))})
    want = generators.select_response(both, "i", "w", "response", "t")
    assert sorted(map(tuple, got.select("i", "response", F.col("score").cast("double")).collect())) == sorted(map(tuple, want.select("i", "response", F.col("score").cast("double")).collect()))
