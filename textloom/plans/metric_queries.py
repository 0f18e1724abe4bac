"""Queries over metrics, statistics and the rate limiter."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import STOP_EN, eval_tokens
from textloom.operators import dedupe, metrics, pairs
from textloom.plans import sql
from textloom.plans.text_queries import table
from textloom.streaming import jobs


def _measured(spark, d):
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    halves = p.select("conv", "turn", F.col("ctx").alias("query"), F.col("resp").alias("gold"), F.concat_ws(" ", "ctx", "resp").alias("generated"))
    return metrics.measure(halves, stop=STOP_EN)


def metric_table(spark, d):
    cols = ("copy_bleu", "copy_prec1", "rep2", "distinct1", "fluency", "topic_q", "gold_recall", "length_ratio", "avg_word_len", "gen_index", "qa_score")
    return _measured(spark, d).select("conv", "turn", *[F.round(c, 6).alias(c) for c in cols])


def metric_report(spark, d):
    r = metrics.aggregate_report(_measured(spark, d))
    return r.select("n", "n_empty", *[F.round(c, 6).alias(c) for c in ("copy_prec1_mean", "copy_prec1_std", "rep2_mean", "rep2_std", "distinct1_mean", "gold_recall_mean")])


def paired_t(spark, d):
    docs = table(spark, d, "documents")
    a = docs.select("doc_id", F.col("n_chars").cast("double").alias("x"))
    b = docs.where("doc_id % 3 <> 0").select("doc_id", F.size(eval_tokens(F.col("text"))).cast("double").alias("x"))
    r = metrics.paired_t(a, b, "doc_id", "x")
    return r.select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 6).alias("t"), "significant")


def mcnemar(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return metrics.mcnemar(rows, "a", "b").select("b01", "b10", F.round("z", 6).alias("z"))


def length_distribution(spark, d):
    r = metrics.distribution(table(spark, d, "documents"), "n_chars", ["lang"])
    return r.select("lang", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "se", "p50", "p95")])


def label_rates(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality") == 1).alias("n_good"))


def threshold_sweep(spark, d):
    rows = table(spark, d, "documents").select((F.size(F.array_distinct(eval_tokens(F.col("text")))) / F.greatest(F.lit(1), F.size(eval_tokens(F.col("text"))))).alias("v"))
    return metrics.threshold_sweep(rows, "v", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])


def best_of_source(spark, d):
    docs = table(spark, d, "documents").withColumn("ok", F.col("n_chars") < 5000)
    return metrics.best_of(docs, "source", "doc_id", "text", "ok")


def rag_stats(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("knowledge"))
    return metrics.rag_context_stats(docs)


def case_damage(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
    return metrics.case_damage(words)


def repeated_answers(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", eval_tokens(F.col("text")).alias("t"))
    return dedupe.repeated_answers(c, "conv_id", "turn", "t", 0.05).select(F.col("g").alias("conv_id"), F.col("ord").alias("turn"), "earlier")


def rate_limit(spark, d):
    return jobs.rate_limited(table(spark, d, "events"), "event_id", "user_id", "ts", limit=3, seconds=86_400.0)


def worst_items(spark, d):
    m = _measured(spark, d).withColumn("key", F.col("conv") * 1000 + F.col("turn")).withColumn("qa_score", F.round("qa_score", 6))
    return metrics.worst(m, "qa_score", "key", 5).select("conv", "turn", "qa_score")


def common_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(eval_tokens(F.col("text"))).alias("word"))
    return metrics.most_common(words, "word", 20)


def hit_rates(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    hit = metrics.usable_hit(F.when(F.col("doc_id") % 3 == 0, "sohbet_sinifi_DEGIL"), F.when(F.col("doc_id") % 5 == 0, "Anlayamadim").otherwise(F.col("quality").cast("string")), F.col("toxic").cast("string"), F.col("quality") == 1)
    out = metrics.hit_rates(j, ["lang"], {"usable": hit, "toxic": F.col("toxic") == 1})
    return out.select("lang", "n", "n_usable", "n_toxic", F.round("rate_usable", 6).alias("rate_usable"), F.round("rate_toxic", 6).alias("rate_toxic"))


def token_accuracy(spark, d):
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    rows = p.select(eval_tokens(F.col("ctx")).alias("predicted"), eval_tokens(F.col("resp")).alias("target")).withColumn("mask", F.transform("target", lambda x, i: (i % 3 != 0).cast("int")))
    return metrics.token_accuracy(rows).select("right", "counted", F.round("accuracy", 6).alias("accuracy"))


def order_revenue(spark, d):
    """Star-schema smoke: revenue by nation and year."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {f.__name__: f for f in (metric_table, metric_report, paired_t, mcnemar, length_distribution, label_rates, threshold_sweep, best_of_source, rag_stats, case_damage, repeated_answers, rate_limit, order_revenue, worst_items, common_words, hit_rates, token_accuracy)}


def _clipped(ref: str, cand: str) -> str:
    return f"list_sum(list_transform(list_distinct({cand}), lambda x: least(len(list_filter({cand}, lambda y: y = x)), len(list_filter({ref}, lambda y: y = x)))))"


def _grams(t: str, n: int) -> str:
    return t if n == 1 else f"list_transform(range(1, len({t}) - {n - 2}), lambda i: {' || chr(32) || '.join(f'{t}[i + {k}]' for k in range(n))})"


_content = lambda t: f"list_filter({t}, lambda w: length(w) > 1 AND NOT list_contains({sql.words(STOP_EN)}, w))"
_METRICS = f"""
    WITH {sql.RAW_PAIRS}, t AS (SELECT conv, turn, {sql.eval_tokens("ctx || ' ' || resp")} AS c, {sql.eval_tokens('resp')} AS r, {sql.eval_tokens('ctx')} AS q FROM pairs),
    g AS (SELECT *, {', '.join(f'{_grams("c", n)} AS c{n}, {_grams("r", n)} AS r{n}' for n in range(1, 5))}, list_distinct({_content('c')}) AS cc, list_distinct({_content('r')}) AS rc, list_distinct({_content('q')}) AS qc FROM t),
    h AS (SELECT *, {', '.join(f'coalesce({_clipped(f"r{n}", f"c{n}")}, 0) AS h{n}' for n in range(1, 5))} FROM g),
    p AS (SELECT conv, turn, len(c) AS nc, len(r) AS nr,
        CASE WHEN len(c) = 0 {' '.join(f'OR (len(c) >= {n} AND h{n} = 0)' for n in range(1, 5))} THEN 0 ELSE (CASE WHEN len(c) < len(r) THEN exp(1 - len(r) / greatest(len(c), 1)) ELSE 1 END)
          * exp(({' + '.join(f'CASE WHEN len(c) >= {n} THEN ln(h{n} / len(c{n})) ELSE 0 END' for n in range(1, 5))}) / least(4, len(c))) END AS copy_bleu,
        CASE WHEN len(c) > 0 THEN h1 / len(c) ELSE 0 END AS copy_prec1, CASE WHEN len(c2) > 0 THEN 1 - len(list_distinct(c2)) / len(c2) ELSE 0 END AS rep2,
        CASE WHEN len(c) > 0 THEN len(list_distinct(c)) / len(c) ELSE 0 END AS distinct1, CASE WHEN len(cc) > 0 THEN len(list_intersect(cc, qc)) / len(cc) ELSE 0 END AS topic_q,
        CASE WHEN len(rc) > 0 THEN len(list_intersect(rc, cc)) / len(rc) ELSE 0 END AS gold_recall, CASE WHEN len(r) > 0 THEN len(c) / len(r) ELSE 0 END AS length_ratio,
        CASE WHEN len(c) > 0 THEN list_sum(list_transform(c, lambda w: length(w))) / len(c) ELSE 0 END AS avg_word_len FROM h),
    f AS (SELECT *, 0.5 * (1 - rep2) + 0.5 * distinct1 AS fluency FROM p)"""

ORACLE_SQL = {
    "metric_table": _METRICS + """
        SELECT conv, turn, round(copy_bleu, 6) AS copy_bleu, round(copy_prec1, 6) AS copy_prec1, round(rep2, 6) AS rep2, round(distinct1, 6) AS distinct1, round(fluency, 6) AS fluency, round(topic_q, 6) AS topic_q,
               round(gold_recall, 6) AS gold_recall, round(length_ratio, 6) AS length_ratio, round(avg_word_len, 6) AS avg_word_len, round(0.5 * (1 - copy_bleu) + 0.3 * gold_recall + 0.2 * fluency, 6) AS gen_index,
               round(0.65 * gold_recall + 0.25 * fluency + 0.05 * copy_bleu + 0.05 * greatest(0, 1 - least(1, abs(length_ratio - 1))) - CASE WHEN nc = 0 THEN 0.5 ELSE 0 END, 6) AS qa_score FROM f""",
    "metric_report": _METRICS + """
        SELECT count(*) AS n, count(*) FILTER (nc = 0) AS n_empty, round(avg(copy_prec1), 6) AS copy_prec1_mean, round(stddev_pop(copy_prec1), 6) AS copy_prec1_std, round(avg(rep2), 6) AS rep2_mean,
               round(stddev_pop(rep2), 6) AS rep2_std, round(avg(distinct1), 6) AS distinct1_mean, round(avg(gold_recall), 6) AS gold_recall_mean FROM f""",
    "paired_t": f"""
        WITH d AS (SELECT len({sql.eval_tokens('text')})::DOUBLE - n_chars AS d FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM d)
        SELECT n, round(m, 6) AS mean_diff, round(m / se, 6) AS t, abs(m / se) >= 2 AS significant FROM s""",
    "mcnemar": """
        WITH c AS (SELECT count(*) FILTER (quality <> 1 AND toxic = 0) AS b01, count(*) FILTER (quality = 1 AND toxic <> 0) AS b10 FROM labels)
        SELECT b01, b10, round((abs(b01 - b10) - 1) / sqrt(b01 + b10), 6) AS z FROM c""",
    "length_distribution": """
        SELECT lang, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, round(stddev_samp(n_chars) / sqrt(count(*)), 6) AS se,
               round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY 1""",
    "label_rates": "SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 1) AS n_good FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "threshold_sweep": f"""
        WITH v AS (SELECT len(list_distinct({sql.eval_tokens('text')})) / greatest(1, len({sql.eval_tokens('text')})) AS v FROM documents), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS threshold)
        SELECT threshold, count(*) AS n, count(*) FILTER (v >= threshold) AS accepted FROM v, t GROUP BY 1""",
    "best_of_source": "SELECT source, arg_max(text, length(text) * 1000000000 - doc_id) AS best FROM (SELECT source, doc_id, text FROM documents WHERE n_chars < 5000) GROUP BY 1",
    "rag_stats": "SELECT count(*) FILTER (doc_id % 4 <> 0 AND text <> '') AS with_context, count(DISTINCT CASE WHEN doc_id % 4 <> 0 AND text <> '' THEN text END) AS distinct_context, count(*) AS pairs FROM documents",
    "case_damage": r"""
        WITH w AS (SELECT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM documents), s AS (SELECT translate(word, 'çğıöşüÇĞİÖŞÜ', 'cgiosucgiosu') AS x FROM w WHERE regexp_matches(word, '[^\x00-\x7F]') AND regexp_matches(word, '\p{Lu}'))
        SELECT count(*) AS n, count(*) FILTER (x = lower(x)) AS damaged FROM s""",
    "repeated_answers": f"""
        WITH a AS (SELECT conv_id, turn, list_distinct({sql.eval_tokens('text')}) AS t FROM conversations WHERE role = 'assistant'),
             j AS (SELECT a.conv_id, a.turn, b.turn AS o, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS n, len(b.t) AS m FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn < a.turn)
        SELECT conv_id, turn, min(o) AS earlier FROM j WHERE n > 0 AND m > 0 AND s / (n + m - s) >= 0.05 GROUP BY 1, 2""",
    "worst_items": _METRICS + """
        , s AS (SELECT conv, turn, round(0.65 * gold_recall + 0.25 * fluency + 0.05 * copy_bleu + 0.05 * greatest(0, 1 - least(1, abs(length_ratio - 1))) - CASE WHEN nc = 0 THEN 0.5 ELSE 0 END, 6) AS qa_score FROM f)
        SELECT conv, turn, qa_score FROM s ORDER BY qa_score, conv * 1000 + turn LIMIT 5""",
    "common_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.eval_tokens('text')}) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
    "hit_rates": """
        WITH h AS (SELECT lang, toxic = 1 AS t, CASE WHEN doc_id % 3 = 0 THEN quality <> 1 WHEN doc_id % 5 = 0 THEN false ELSE quality = toxic END AS u FROM labels JOIN documents USING (doc_id))
        SELECT lang, count(*) AS n, count(*) FILTER (u) AS n_usable, count(*) FILTER (t) AS n_toxic, round(count(*) FILTER (u) / count(*), 6) AS rate_usable, round(count(*) FILTER (t) / count(*), 6) AS rate_toxic FROM h GROUP BY 1""",
    "token_accuracy": f"""
        WITH {sql.RAW_PAIRS}, t AS (SELECT {sql.eval_tokens('ctx')} AS p, {sql.eval_tokens('resp')} AS r FROM pairs),
             i AS (SELECT p, r, unnest(range(0, least(len(p), len(r) - 1))) AS i FROM t)
        SELECT count(*) FILTER (p[i + 1] = r[i + 2]) AS right, count(*) AS counted, round(count(*) FILTER (p[i + 1] = r[i + 2]) / count(*), 6) AS accuracy FROM i WHERE i % 3 <> 0""",
    "order_revenue": """
        SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
}
