"""Queries over the text functions and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import gates, text, tokens
from textloom.plans import sql

_T = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


def clean_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_chars(F.col("text")).alias("cleaned"))


def turkish_lower(spark, d):
    return table(spark, d, "documents").select("doc_id", text.turkish_lower(F.col("text")).alias("lowered"))


def pattern_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.pattern_key(F.col("text")).alias("key"))


def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


def crawl_clean(spark, d):
    return table(spark, d, "pages").select("page_id", text.crawl_clean(F.col("html")).alias("body"))


def cut_at_word(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cut_at_word(text.clean_chars(F.col("text")), 64).alias("cut"))


def refine_response(spark, d):
    return table(spark, d, "documents").select("doc_id", text.refine_response(text.clean_chars(F.col("text")), 204).alias("refined"))


def sentence_stats(spark, d):
    s = text.sentences(F.col("text"))
    u = text.usable_sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.size(u).alias("n_usable"))


def paragraph_chunks(spark, d):
    """Lines as paragraphs (the documents have no blank lines); long ones as packs of sentences."""
    lines = table(spark, d, "documents").select(F.explode(text.paragraphs(F.col("text"), gap=r"\n")).alias("para"))
    return lines.select(F.substring(F.sha1("para"), 1, 12).alias("id"), F.substring("para", 1, 120).alias("title"), F.length("para").alias("n")).groupBy("id", "title", "n").agg(F.count(F.lit(1)).alias("copies"))


def language_gate(spark, d):
    t = F.col("text")
    score, latin = gates.language_score(t), gates.latin_share(t)
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"), F.round(latin, 6).alias("latin"), gates.is_foreign(t).alias("foreign"))


def exam_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.is_exam_residue(F.col("text")).alias("exam"), gates.is_truncated(F.col("text")).alias("truncated"), gates.is_harmful(F.col("text")).alias("harmful"))


def corpus_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.is_corpus_worthy(F.col("text")).alias("worthy"))


def line_gate_funnel(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    gated = lines.select(gates.line_gate(F.col("line")).alias("g"))
    return gated.groupBy(F.coalesce("g.reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("g.line")), F.lit(0)).alias("chars"))


def word_counts(spark, d):
    each = table(spark, d, "documents").select(F.explode(tokens.ascii_tokens(F.col("text"))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def trigram_counts(spark, d):
    each = table(spark, d, "documents").select(F.explode(tokens.trigram_set(F.col("text"))).alias("tri"))
    return each.groupBy("tri").agg(F.count(F.lit(1)).alias("df"))


def bigram_counts(spark, d):
    each = table(spark, d, "documents").select(F.explode(tokens.ngrams(tokens.eval_tokens(F.col("text")), 2)).alias("gram"))
    return each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def stemmed_terms(spark, d):
    """Stems and bigrams of all documents, as the engine makes them, stop words among them."""
    toks = tokens.tokenised(table(spark, d, "documents"), "doc_id", "text", tokens.STOPWORDS)
    return toks.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def djb2_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.djb2(F.col("text")).alias("hash"))


def topic_terms(spark, d):
    """Whole topic words, topic stems and the search query of every document."""
    docs = table(spark, d, "documents")
    topics = tokens.topic_words(tokens.with_bigrams(tokens.stem_words(tokens.plain_words(F.col("text"))), tokens.STOPWORDS))
    return docs.select("doc_id", F.array_join(tokens.raw_words(F.col("text")), " ").alias("raw"), F.array_join(F.array_sort(topics), " ").alias("topics"), tokens.clean_query(F.col("text")).alias("query"))


def sentence_splits(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.plain_sentences(t), "|").alias("plain"), text.joined_sentences(text.marked_sentences(t)).alias("joined"))


def answer_marks(spark, d):
    t = F.col("text")
    marks = gates.fallback_marks(t, ["ayrica", "bir bakima", "in", "de"])
    rows = table(spark, d, "documents").select("doc_id", marks.alias("m"), gates.is_blank_bucket(t).alias("blank"), gates.is_cut(t).alias("cut"))
    return rows.select("doc_id", "m.lower_start", "m.unfinished", F.array_join("m.fillers", ",").alias("fillers"), "m.chars", "blank", "cut")


QUERIES = {f.__name__: f for f in (ascii_fold, clean_chars, turkish_lower, pattern_key, slug, html_text, crawl_clean, cut_at_word, refine_response, sentence_stats, paragraph_chunks, language_gate, exam_gate, corpus_gate, line_gate_funnel, word_counts, trigram_counts, bigram_counts, stemmed_terms, djb2_hash, topic_terms, sentence_splits, answer_marks)}

_html = r"regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<[^>]+>', ' ', 'g')"
for _k, _v in text.ENTITIES.items():
    _html = f"replace({_html}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
_html = rf"trim(regexp_replace(regexp_replace({_html}, ':[a-zA-Z0-9_+\-]+:', ' ', 'g'), '[ \t\n\x0B\f\r\x{{85}}\x{{A0}}]{{2,}}', ' ', 'g'), chr(32) || chr(10) || chr(9) || chr(13) || chr(160))"
_c = sql.clean("text")
_strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"

ORACLE_SQL = {
    "ascii_fold": f"SELECT doc_id, {sql.fold('text')} AS folded FROM documents",
    "clean_chars": f"SELECT doc_id, {_c} AS cleaned FROM documents",
    "turkish_lower": "SELECT doc_id, lower(translate(text, 'İI', 'iı')) AS lowered FROM documents",
    "pattern_key": rf"SELECT doc_id, regexp_replace(regexp_replace(lower({sql.fold('text')}), '\s+', ' ', 'g'), '^[?!.,;: ]+|[?!.,;: ]+$', '', 'g') AS key FROM documents",
    "slug": f"SELECT doc_id, replace({sql.fold('lower(' + _strip('text') + ')')}, ' ', '_') AS slug FROM documents",
    "html_text": f"SELECT page_id, {_html} AS body FROM pages",
    "crawl_clean": r"SELECT page_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '(?i)\bhttps?://[^ \t\n\r\f]+', ' ', 'g'), '[ \t\x{A0}]+', ' ', 'g'), chr(13), ' '), chr(32) || chr(10) || chr(9)) AS body FROM pages",
    "cut_at_word": f"WITH c AS (SELECT doc_id, {_c} AS t FROM documents) SELECT doc_id, {sql.cut('t', 64)} AS cut FROM c",
    "refine_response": f"""
        WITH c AS (SELECT doc_id, {_c} AS t FROM documents), e AS (SELECT doc_id, t, regexp_extract(substring(t, 1, 204), '(?s)^(.{{15,}}[.?:!])', 1) AS ended FROM c)
        SELECT doc_id, CASE WHEN length(t) < 10 THEN NULL WHEN length(t) <= 204 THEN t WHEN ended <> '' THEN trim(ended) ELSE {sql.cut('t', 204)} END AS refined FROM e""",
    "sentence_stats": f"SELECT doc_id, len({sql.sentences('text')}) AS n_sentences, len(list_filter({sql.sentences('text')}, lambda s: length(s) > 25 AND length(s) < 250 AND NOT regexp_matches(s, '(?i)http|www'))) AS n_usable FROM documents",
    "paragraph_chunks": r"""
        WITH c AS (SELECT trim(replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?i)\bhttps?://[^ \t\n\r\f]+', ' ', 'g'), '[ \t\x{A0}]+', ' ', 'g'), chr(13), ' '), chr(32) || chr(10) || chr(9)) AS t FROM documents),
             p AS (SELECT trim(unnest(string_split(t, chr(10)))) AS para FROM c),
             k AS (SELECT para, string_split(regexp_replace(para, '([.!?])[ \n]+', '\1' || chr(30), 'g'), chr(30)) AS ss FROM p WHERE length(para) >= 40),
             f AS (SELECT para, list_reduce(list_prepend({'done': []::VARCHAR[], 'pack': '', 'used': 0::BIGINT}, list_transform(ss, lambda s: {'done': []::VARCHAR[], 'pack': s, 'used': 0::BIGINT})),
                       lambda a, x: CASE WHEN length(x.pack) >= 40 AND (a.used + length(x.pack) + 1 >= 300 OR length(CASE WHEN a.used = 0 THEN x.pack ELSE a.pack || ' ' || x.pack END) > 900)
                         THEN {'done': list_append(a.done, substring(CASE WHEN a.used = 0 THEN x.pack ELSE a.pack || ' ' || x.pack END, 1, 1200)), 'pack': '', 'used': 0::BIGINT}
                         ELSE {'done': a.done, 'pack': CASE WHEN a.used = 0 THEN x.pack ELSE a.pack || ' ' || x.pack END, 'used': (a.used + length(x.pack) + 1)::BIGINT} END) AS s FROM k WHERE length(para) > 1200),
             q AS (SELECT para FROM p WHERE length(para) >= 40 AND length(para) <= 1200 UNION ALL SELECT unnest(s.done) FROM f UNION ALL SELECT substring(s.pack, 1, 1200) FROM f WHERE length(s.pack) >= 40)
        SELECT substring(sha1(para), 1, 12) AS id, substring(para, 1, 120) AS title, length(para) AS n, count(*) AS copies FROM q GROUP BY 1, 2, 3""",
    "language_gate": f"""
        WITH s AS (SELECT doc_id, text, {sql.stop_share('text', tokens.STOP_TR)} - {sql.stop_share('text', tokens.STOP_EN)} AS score, {sql.latin_share('text')} AS latin FROM documents)
        SELECT doc_id, round(score, 6) AS score, round(latin, 6) AS latin, trim(coalesce(text, '')) <> '' AND (latin < 0.5 OR score < -0.08) AS foreign FROM s""",
    "exam_gate": rf"""
        WITH c AS (SELECT doc_id, text, {_c} AS t, {_strip(sql.text('text'))} AS s FROM documents)
        SELECT doc_id, len(regexp_extract_all(t, '\( *\)')) >= 2 OR len(regexp_extract_all(t, '(?:^| )[a-e]\)')) >= 2 AS exam,
               length(s) < 5 OR regexp_matches(s, '\(\s*d\.?\s*$|\(\s*$') OR len(regexp_split_to_array(s, '\s+')) <= 1 AS truncated,
               regexp_matches(lower({sql.fold('text')}), '{"|".join(gates.HARMFUL)}') AS harmful FROM c""",
    "corpus_gate": f"SELECT doc_id, length(coalesce(text, '')) >= 200 AND len({sql.sentences('text')}) >= 2 AS worthy FROM documents",
    "word_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.ascii_tokens('text')}) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 2",
    "trigram_counts": f"""
        WITH c AS (SELECT regexp_replace(lower({sql.fold('text')}), '[^a-z0-9]', '', 'g') AS t FROM documents),
             g AS (SELECT unnest(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))) AS tri FROM c WHERE length(t) >= 3)
        SELECT tri, count(*) AS df FROM g GROUP BY 1""",
    "bigram_counts": f"""
        WITH t AS (SELECT {sql.eval_tokens('text')} AS w FROM documents)
        SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) GROUP BY 1""",
    "djb2_hash": "SELECT doc_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (h * 33 + x) & 2147483647) AS hash FROM documents",
    "stemmed_terms": f"""
        WITH RECURSIVE {sql.tokens(search=False, d="SELECT doc_id AS id, text FROM documents")}
        SELECT term, count(*) AS n FROM (SELECT unnest(ts) AS term FROM d_toks) GROUP BY 1""",
    "topic_terms": f"""
        WITH RECURSIVE {sql.tokens(search=False, d="SELECT doc_id AS id, text FROM documents")},
        raw AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS raw FROM d_words JOIN stems USING (word)
                WHERE length(word) >= 3 AND NOT list_contains({sql.words(tokens.STOPWORDS + tokens.QUESTION_WORDS)}, word) AND NOT list_contains({sql.words(tokens.weak_stems() + tokens.QUESTION_WORDS)}, stem) GROUP BY 1),
        top AS (SELECT id, array_to_string(list_sort(list_distinct(list_filter(ts, lambda w: NOT list_contains({sql.words(tokens.STOPWORDS + tokens.weak_stems())}, w)))), ' ') AS topics FROM d_toks)
        SELECT doc_id, coalesce(raw, '') AS raw, coalesce(topics, '') AS topics,
               array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(lower({sql.text('text')}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({sql.words(tokens.STOP_QUERY)}, w)), 1, 6), ' ') AS query
        FROM documents LEFT JOIN raw ON raw.id = doc_id LEFT JOIN top ON top.id = doc_id""",
    "sentence_splits": rf"""
        WITH s AS (SELECT doc_id, regexp_replace({sql.text('text')}, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(65294) || '\2', 'g') AS p, trim({sql.text('text')}, chr(32) || chr(10) || chr(9) || chr(13)) AS t FROM documents)
        SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(p, '[.!?…]+\s*'), lambda x: trim(replace(x, chr(65294), '.'), chr(32) || chr(10) || chr(9) || chr(13))), lambda x: x <> ''), '|') AS plain,
               array_to_string(list_transform(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: x <> ''), lambda x: regexp_replace(x, '[.!?]+$', '') || '.'), ' ') AS joined FROM s""",
    "answer_marks": rf"""
        WITH s AS (SELECT doc_id, trim({sql.text('text')}) AS t, lower({sql.fold('trim(text)')}) AS low FROM documents)
        SELECT doc_id, regexp_matches(t, '^\p{{Ll}}') AS lower_start, t <> '' AND NOT regexp_matches(t, '[.!?…]$') AS unfinished, array_to_string(list_filter(['ayrica', 'bir bakima', 'in', 'de'], lambda x: contains(low, x)), ',') AS fillers,
               length(t)::INT AS chars, regexp_matches(lower(t), '{"|".join(gates.NO_KNOWLEDGE)}') AS blank, regexp_matches(t, '\p{{L}}$') AS cut FROM s""",
    "line_gate_funnel": rf"""
        WITH l AS (SELECT unnest(string_split(text, chr(10))) AS raw FROM documents),
             a AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '{gates.MARKUP}', '', 'g'), '{gates.SOFT_PII}', '', 'g'), '{sql.SPACES}{{2,}}', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS t FROM l),
             b AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(t, '{sql.FOREIGN}', ' ', 'g'), '{sql.SPACES}{{2,}}', ' ', 'g'), '^{sql.SPACES}+|{sql.SPACES}+$', '', 'g') AS t FROM a),
             c AS (SELECT raw, t, regexp_extract_all(t, '\p{{L}}') AS ls FROM b),
             r AS (SELECT t, CASE WHEN raw = '' THEN 'empty' WHEN regexp_matches(raw, '{gates.HARD_PII}') THEN 'personal' WHEN length(t) < 4 OR length(t) > 140 THEN 'length' WHEN regexp_matches(lower(t), 'http|www\.|reddit\.com') THEN 'link'
                          WHEN regexp_matches(lower({sql.fold('t')}), '{"|".join(gates.HARMFUL)}') THEN 'harmful' WHEN len(regexp_split_to_array(t, '{sql.SPACES}+')) < 3 THEN 'words' WHEN len(ls) < 4 OR len(list_distinct(ls)) < floor(len(ls) * 0.25) THEN 'letters' ELSE 'kept' END AS reason FROM c)
        SELECT reason, count(*) AS n, sum(CASE WHEN reason = 'kept' THEN length(t) ELSE 0 END)::BIGINT AS chars FROM r GROUP BY 1""",
}
