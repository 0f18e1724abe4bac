"""Queries over the builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import STOP_EVAL, ascii_tokens
from textloom.operators import generators, subwords
from textloom.plans import sql
from textloom.plans.text_queries import table


def spelling_lexicon(spark, d):
    return generators.spelling_lexicon(table(spark, d, "documents"), "doc_id", "text")


def respelled(spark, d):
    docs = table(spark, d, "documents")
    lexicon = generators.spelling_lexicon(docs, "doc_id", "text")
    return generators.respelled(table(spark, d, "benchmark"), "item_id", "text", lexicon).select(F.col("id").alias("item_id"), "text")


def learned_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), "text")
    return generators.learned_ids(docs, "title", "text").select("doc_id", "id")


def extract_count(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("bana "), (F.col("doc_id") % 15).cast("string"), F.lit(" film oner")).alias("m"))
    return docs.select("doc_id", generators.extract_count(F.col("m")).alias("n"))


def dialogue_memory(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, F.substring("text", 1, 12)).alias("tag"))
    return generators.dialogue_memory(turns, "conv_id", "turn", "tag").select("conv_id", "turn", "last_tag")


def select_response(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("text").alias("response"))
    q = table(spark, d, "benchmark").select("item_id", (F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es"))[(F.col("item_id") % 4).cast("int")]).alias("lang"), "text")
    return generators.matched_responses(q, "item_id", "text", docs, "response", "lang").select("item_id", F.col("score").cast("double").alias("score"))


def markov_text(spark, d):
    edges = subwords.transitions(table(spark, d, "documents"), "doc_id", "text")
    starts = table(spark, d, "benchmark").select("item_id", F.element_at(ascii_tokens(F.col("text")), 1).alias("w"))
    return generators.markov_text(edges, starts, "item_id", "w").select(F.col("id").alias("item_id"), "text")


def paraphrased(spark, d):
    p = generators.Paraphraser({"the": ["this", "that"], "and": ["plus"]}, ["indeed."], ["moreover"])
    return generators.paraphrased(table(spark, d, "benchmark"), "text", p, 2)


QUERIES = {f.__name__: f for f in (spelling_lexicon, respelled, learned_ids, extract_count, dialogue_memory, select_response, markov_text, paraphrased)}

_LEXICON = rf"""
    w AS (SELECT doc_id AS o, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), 1) AS p FROM documents),
    k AS (SELECT o, p, w, lower({sql.fold('w')}) AS key, lower(translate(w, 'İI', 'iı')) AS low, regexp_matches(w, '^[A-Z0-9]*[A-Z][A-Z0-9]*$') AND length(w) >= 2 AS acro FROM w),
    g AS (SELECT key, bool_or(acro) AS bad, arg_min(low, o * 1000000 + p) FILTER (NOT acro AND (key <> low OR regexp_matches(w, '[^\x00-\x7F]')) AND length(key) >= 2) AS form FROM k GROUP BY 1),
    lex AS (SELECT key, form FROM g WHERE NOT bad AND form IS NOT NULL)"""

ORACLE_SQL = {
    "spelling_lexicon": f"WITH {_LEXICON} SELECT key, form FROM lex",
    "respelled": rf"""
        WITH {_LEXICON}, b AS (SELECT item_id, unnest(regexp_extract_all(text, '[\p{{L}}]+|[^\p{{L}}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}]+|[^\p{{L}}]+'), 1) AS p FROM benchmark),
             j AS (SELECT item_id, p, CASE WHEN form IS NULL THEN b.w WHEN substring(b.w, 1, 1) <> lower(substring(b.w, 1, 1)) THEN upper(substring(form, 1, 1)) || substring(form, 2) ELSE form END AS w FROM b LEFT JOIN lex ON lower({sql.fold('b.w')}) = key)
        SELECT item_id, string_agg(w, '' ORDER BY p) AS text FROM j GROUP BY 1""",
    "markov_text": f"""
        WITH RECURSIVE s AS (SELECT unnest({sql.sentences('text')}) AS s FROM documents), t AS (SELECT {sql.ascii_tokens('s')} AS w FROM s),
             e AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM t), c AS (SELECT p[1] AS head, p[2] AS next, count(*) AS n FROM e GROUP BY 1, 2),
             h AS (SELECT head, sum(n) AS t FROM c GROUP BY 1), k AS (SELECT head, next, pow(n::DOUBLE, 1 / 1.15::DOUBLE) AS w FROM c JOIN h USING (head) WHERE t >= 3 AND n >= 2 QUALIFY row_number() OVER (PARTITION BY head ORDER BY n DESC, next) <= 6),
             u AS (SELECT head, next, sum(w) OVER (PARTITION BY head ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (PARTITION BY head) AS upto FROM k),
             xs AS MATERIALIZED (SELECT head, list({{'upto': upto, 'next': next}} ORDER BY upto, next) AS x FROM u GROUP BY 1),
             walk AS (SELECT item_id, 1 AS step, {sql.ascii_tokens('text')}[1] AS last, {sql.ascii_tokens('text')}[1] AS txt FROM benchmark
                      UNION ALL SELECT item_id, step + 1, nx, txt || ' ' || nx FROM (
                        SELECT item_id, step, txt, coalesce(list_filter(x, lambda y: y.upto > ('0x' || substring(md5(item_id || ':' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE)[1], x[len(x)]).next AS nx FROM walk JOIN xs ON last = head WHERE step < 12))
        SELECT item_id, arg_max(txt, step) AS text FROM walk GROUP BY 1""",
    "learned_ids": """
        WITH b AS (SELECT doc_id, text, 'ogr_' || lang || '_' || substring(sha1(text), 1, 8) AS b FROM documents), r AS (SELECT doc_id, b, dense_rank() OVER (PARTITION BY b ORDER BY text) AS r FROM b)
        SELECT doc_id, CASE WHEN r = 1 THEN b ELSE b || '_' || r END AS id FROM r""",
    "extract_count": "SELECT doc_id, CASE WHEN doc_id % 15 BETWEEN 1 AND 10 THEN (doc_id % 15)::INT END AS n FROM documents",
    "dialogue_memory": """
        SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN substring(text, 1, 12) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_tag FROM conversations""",
    "select_response": f"""
        WITH d AS (SELECT lang, text AS r FROM documents), q AS (SELECT item_id, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS lang, {sql.ascii_tokens('text')} AS w FROM benchmark),
             c AS (SELECT item_id, list_distinct(list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({sql.words(STOP_EVAL)}, x))) AS w, {sql.ascii_tokens('r')} AS t, lower({sql.fold('r')}) AS f FROM q JOIN d USING (lang))
        SELECT item_id, max(len(list_intersect(w, list_distinct(t))) + 0.5 * len(list_filter(w, lambda x: contains(f, x))))::DOUBLE AS score FROM c GROUP BY 1""",
}
