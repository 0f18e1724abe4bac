import json

import pandas as pd
from pyspark.sql import functions as F

from textloom.sources import files, web
from textloom.streaming import jobs


def fake(url, params):
    if "latest" in url:
        page = params["page"]
        return {"topic_list": {"topics": [{"id": 10 * page + k, "title": f"t{page}{k}"} for k in range(2)], "more_topics_url": "x" if page == 0 else None}}
    if "/t/" in url:
        return {"post_stream": {"posts": [{"username": "system", "cooked": "no"}, {"username": "u", "cooked": "<p>yes</p>"}]}}
    if "query" in str(params):
        return {"query": {"pages": {"1": {"title": params["titles"], "extract": "text"}}}}
    return {}


def test_chats(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"query": "q1", "answer": ["x", "y"], "score": 3}\nnot json\n\n{"answer": "z"}\n')
    b.write_text(json.dumps({"soru": "q2", "answer": "one"}) + "\n")
    rows = files.scan_chats(spark, [str(a), str(b)], defaults=True).orderBy("ord").collect()
    assert [(r["query"], r["answer"], r["source"], r["score"]) for r in rows] == [("q1", ["x", "y"], "seed", 3), ("q2", ["one"], "seed", 0)]


def test_corpus_rejects(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "title": "T", "text": "x"}\n{bad\n')
    good, bad = files.scan_corpus(spark, str(tmp_path / "c.jsonl"))
    assert good.count() == 1 and bad.count() == 1


def test_intents(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"intents": [{"tag": "a", "patterns": ["p"], "responses": ["rr"]}, {"tag": "a", "patterns": [], "responses": ["r"]}]}))
    v = files.intent_violations(files.scan_intents(spark, str(tmp_path / "i.json"))).first()
    assert (v["short_tag"], v["repeated_tag"], v["no_patterns"], v["short_response"]) == (2, 1, 1, 1)


def test_comment_tree():
    tree = {"data": {"children": [{"data": {"body": "a", "author": "x", "replies": {"data": {"children": [{"data": {"body": "b", "author": "y"}}]}}}}, {"data": {"body": "bot", "author": "AutoModerator"}}]}}
    assert list(web.comment_bodies(tree)) == ["a", "b"]


def test_forum_pages(monkeypatch):
    monkeypatch.setattr(web, "http_json", fake)
    reader = web._ForumReader({"url": "https://forum.example", "want": "10"})
    rows = list(reader.read(reader.partitions()[0]))
    assert [r[0] for r in rows] == [0, 1, 10, 11] and rows[0][2] == ["<p>yes</p>"]
    extracts = web._ExtractReader({"url": "u", "items": "|".join(str(k) for k in range(12))})
    assert len(extracts.partitions()) == 2


def test_ingest_is_idempotent(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    text = "A paragraph that is certainly long enough to be kept."
    spark.createDataFrame([(text,), (text + " Second.",)], "text string").write.parquet(src)
    for _ in range(2):
        jobs.ingest_shards(spark, src, "text string", "text", out, ckpt).awaitTermination()
        spark.createDataFrame([(text,)], "text string").write.mode("append").parquet(src)
    jobs.ingest_shards(spark, src, "text string", "text", out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_limiter(spark):
    events = pd.DataFrame({"id": range(7), "key": 1, "at": [0.0, 1.0, 2.0, 30.0, 60.0, 61.0, 130.0]})
    assert jobs.allow(events, limit=3, seconds=60)["allowed"].tolist() == [True, True, True, False, True, True, True]
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate([0, 1, 2, 30, 60])], "id long, k long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = jobs.rate_limited(rows, "id", "k", "ts", 3, 60.0).orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, True]
