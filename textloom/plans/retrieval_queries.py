"""Queries over the inverted index, dense vectors, routing and subword statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import STOPWORDS, ascii_tokens, engine_tokens, plain_words, stem_words, with_bigrams
from textloom.operators import packed, routing, search, semantic, subwords
from textloom.plans import sql
from textloom.plans.text_queries import table
from textloom.storage import materialise


def _index(spark, d, title: bool = False):
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 120).alias("title"))
    return search.build_index(docs, "doc_id", "text", "title" if title else None, engine_tokens)


def _asked(spark, d):
    return search.query_terms(table(spark, d, "benchmark"), "item_id", "text", engine_tokens)


def index_terms(spark, d):
    return _index(spark, d, True).terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("bm25", 6).alias("bm25"))


def bm25_top3(spark, d):
    index = _index(spark, d)
    terms = _asked(spark, d)
    return search.top(search.bm25(index, terms), "bm25", 3).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.col("bm25").alias("score"), "rank")


def bm25_top1(spark, d):
    """The flagship: for each benchmark text its best document."""
    index = _index(spark, d, True)
    terms = _asked(spark, d)
    return search.top(search.bm25(index, terms), "bm25", 1).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.col("bm25").alias("score"))


def tfidf_top3(spark, d):
    index = _index(spark, d)
    terms = _asked(spark, d)
    return search.top(search.tfidf(index, terms), "lex", 3).select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.col("lex").alias("score"), "rank")


def fused_search(spark, d):
    """The whole retrieval chain without dense vectors."""
    found = search.search(_index(spark, d, True), table(spark, d, "benchmark"), "item_id", "text", tokens=engine_tokens)
    return found.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"))


def semantic_search(spark, d):
    """The whole chain with LSA similarities and PPMI expansion."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 120).alias("title"))
    whole = packed.build(docs, "doc_id", "text", "title")
    queries = table(spark, d, "benchmark")
    terms = materialise(_asked(spark, d), "asked")
    more = materialise(semantic.expansion(packed.word_vectors(whole, 50), terms), "expansion")
    vectors, basis = packed.lsa(whole, terms, k=64)
    q = materialise(semantic.fold_in(basis, terms), "asked-vectors")
    index = packed.lookup(whole, terms.select("term").unionByName(more.select("term")))
    found = search.search(index, queries, "item_id", "text", semantic=semantic.similarities(vectors, q), expansion=more, tokens=engine_tokens)
    return found.select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 3).alias("score"))


def ppmi_pairs(spark, d):
    """The five strongest associations of every term of the space."""
    pairs = semantic.ppmi(_index(spark, d)).where("ppmi > 0").select(F.col("a").alias("q"), F.col("b").alias("doc"), "ppmi")
    return search.top(pairs, "ppmi", 5).select(F.col("q").alias("a"), F.col("doc").alias("b"), "ppmi", "rank")


def pattern_division(spark, d):
    """Relational division: the first document whose words hold all words of a query."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), ascii_tokens(F.col("text")).alias("t"))
    p = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), ascii_tokens(F.col("text")).alias("t"))
    return search.pattern_hits(q, "t", p, "t").select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), "score")


def cosine_top5(spark, d):
    e = table(spark, d, "embeddings")
    found = search.cosine_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return found.select(F.col("q").alias("query_id"), F.col("doc").alias("vec_id"), F.round("sim", 3).alias("sim"))


def refresh_plan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return search.refresh_plan(docs.where("doc_id % 19 <> 0"), after, "doc_id", ["text"])


def keyword_attention(spark, d):
    """Languages as tags, document words as keywords, benchmark texts as messages."""
    kw = table(spark, d, "documents").select(F.concat_ws("-", "lang", (F.col("doc_id") % 7).cast("string")).alias("tag"), F.explode(ascii_tokens(F.col("text"))).alias("stem"))
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.explode(ascii_tokens(F.col("text"))).alias("stem"))
    scores = routing.attention(words, kw, routing.keyword_weights(kw))
    ranks = kw.select("tag").distinct().withColumn("rank", F.col("tag"))
    return routing.top_tag(scores, ranks).select(F.col("q").alias("item_id"), "tag", F.round("score", 6).alias("score"))


def exact_pattern_index(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("tag"), F.array("text").alias("patterns"), (F.col("doc_id") % 3 != 0).alias("knowledge"))
    return routing.pattern_index(docs)


#: Parts that the messages of the routing queries are put together from.
_PARTS = [*routing.FEEDBACK, *routing.INADEQUACY, *routing.TRUST, *routing.ADVICE, "bir daha", "baska bir tane daha", "bana fikra anlat", "espri yap", "mizah nedir", "Bu ne demek?", "SAĞLIK için", "merhaba"]
_ENDS = [*routing.SENSITIVE, *routing.FACTUAL, "", "", "", "simdi", "yap", "istanbul"]


def _messages(spark, d):
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % at % len(xs) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", pick(_PARTS, 10_007), pick(_ENDS, 10_009)).alias("m"))


def message_kinds(spark, d):
    """What fixed handling each message gets; stop words weigh nothing, every second dialogue ended in a joke."""
    stems = with_bigrams(stem_words(plain_words(F.col("m"))), STOPWORDS)
    weightless = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    rows = _messages(spark, d).withColumn("stems", stems)
    kind = routing.message_kind(F.col("m"), F.col("stems"), weightless, F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", kind.alias("kind"), routing.is_factual(F.col("m")).alias("factual"), routing.is_knowledge_question(F.col("m")).alias("knowledge"), routing.is_refusal(F.concat(F.lit(" Bu  konuda "), F.when(F.col("doc_id") % 3 == 0, "bilgim yok, ").otherwise("bilgim var, "), "m")).alias("refusal"))


def routes(spark, d):
    """Each document as a message with made-up strengths: whether its class is trusted, and its way."""
    asked = F.array_distinct(ascii_tokens(F.col("text")))
    known = F.array(*[F.lit(w) for w in ("the", "in", "de", "la", "nonesuch")])
    share = lambda n, by: ((F.col("doc_id") * 7) % n) / F.lit(by)
    trusted = routing.can_answer(F.col("doc_id") % 17 == 0, share(20, 20.0), share(9, 4.0), F.col("doc_id") % 5 == 0, asked, known)
    rest = routing.fallback(F.concat_ws(" ", "text", F.when(F.col("doc_id") % 4 == 0, "nedir")), share(11, 10.0), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0)
    kind = F.when(F.col("doc_id") % 23 == 0, "feedback")
    return table(spark, d, "documents").select("doc_id", trusted.alias("trusted"), routing.route(kind, trusted, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0, rest).alias("route"))


def unknown_subjects(spark, d):
    """Messages are benchmark texts; weights are those of the languages' stems."""
    kw = table(spark, d, "documents").select(F.col("lang").alias("tag"), F.explode(engine_tokens(F.col("text"))).alias("stem"))
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.explode(with_bigrams(stem_words(plain_words(F.col("text"))), STOPWORDS)).alias("stem"))
    return routing.unknown_subject(words, routing.keyword_weights(kw)).select(F.col("q").alias("item_id"), "unknown")


def word_frequency(spark, d):
    return subwords.word_frequency(table(spark, d, "documents"), "text", 2)


def char_pair_counts(spark, d):
    return subwords.pair_counts(subwords.word_frequency(table(spark, d, "documents"), "text", 2))


def char_vocabulary(spark, d):
    return subwords.char_vocabulary(table(spark, d, "documents"), "text", 5)


def markov_transitions(spark, d):
    return subwords.transitions(table(spark, d, "documents"), "doc_id", "text")


def bpe_pieces(spark, d):
    """Subwords of the benchmark texts by merges learned from the documents."""
    alphabet = [chr(c) for c in range(97, 123)]
    merges = subwords.train_bpe(table(spark, d, "documents"), "text", 400, alphabet, max_words=None)
    return subwords.encode_texts(table(spark, d, "benchmark"), "item_id", "text", merges).select(F.col("id").alias("item_id"), F.array_join("pieces", " ").alias("pieces"))


QUERIES = {f.__name__: f for f in (index_terms, bm25_top3, bm25_top1, tfidf_top3, fused_search, semantic_search, ppmi_pairs, pattern_division, cosine_top5, refresh_plan, keyword_attention, exact_pattern_index, message_kinds, routes, unknown_subjects, word_frequency, char_pair_counts, char_vocabulary, markov_transitions, bpe_pieces)}

_tok = sql.ascii_tokens("text")
_WORDS = rf"""
    w AS (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(replace(text, chr(160), ' '), 'İI', 'iı')), '\s+', ' ', 'g'), '[^a-zçğıöşüâîû0-9 .,;:!?…()%’''"\-–/]', '', 'g'), ' +', ' ', 'g')), ' ')) AS word FROM documents),
    f AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) >= 2)"""


def _postings(title: bool) -> str:
    """The index's tables on the engine's tokens; the CTE of stems is recursive, as is the WITH before it."""
    sources = {"d": "SELECT doc_id AS id, text FROM documents", "b": "SELECT item_id AS id, text FROM benchmark"} | ({"t": "SELECT doc_id AS id, substring(text, 1, 120) AS text FROM documents"} if title else {})
    titled = "UNION ALL SELECT id AS doc, unnest(ts) AS term, 2.0 AS w FROM t_toks" if title else ""
    return f"""
    {sql.tokens(**sources)},
    raw AS (SELECT id AS doc, unnest(ts) AS term, 1.0 AS w FROM d_toks {titled}),
    post AS MATERIALIZED (SELECT doc, term, sum(w)::DOUBLE AS tf FROM raw GROUP BY 1, 2),
    tot AS (SELECT count(*)::DOUBLE AS n FROM documents),
    terms AS MATERIALIZED (SELECT term, count(*) AS df, ln(n / (1 + count(*))) AS idf, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS bm25 FROM post, tot GROUP BY term, n),
    lens AS (SELECT doc, sum(tf) AS len FROM post GROUP BY 1),
    avgd AS (SELECT greatest(1.0, (sum(len) + n - count(*)) / n) AS a FROM lens, tot GROUP BY n),
    q AS MATERIALIZED (SELECT id AS q, term, count(*) AS cnt FROM (SELECT id, unnest(ts) AS term FROM b_toks) GROUP BY 1, 2)"""


_BM25 = """
    braw AS (SELECT q, doc, sum(bm25 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a)) * cnt) AS raw FROM post JOIN terms USING (term) JOIN q USING (term) JOIN lens USING (doc), avgd GROUP BY 1, 2),
    bm AS (SELECT q, doc, raw / max(raw) OVER (PARTITION BY q) AS s FROM braw)"""
_TFIDF = """
    qv AS (SELECT q, term, (0.5 + cnt) * idf AS w FROM q JOIN terms USING (term)), qn AS (SELECT q, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1),
    dv AS (SELECT doc, term, (0.5 + tf) * idf AS w FROM post JOIN terms USING (term)), dn AS (SELECT doc, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1),
    lex AS (SELECT q, doc, sum(dv.w * qv.w / qn.n) / max(dn.n) AS s FROM dv JOIN qv USING (term) JOIN qn USING (q) JOIN dn USING (doc) WHERE qn.n > 0 AND dn.n > 0 GROUP BY 1, 2)"""
_any = lambda c, xs: f"regexp_matches({c}, '{'|'.join(xs)}')"
_MESSAGES = f"SELECT doc_id, {sql.words(_PARTS)}[doc_id % 10007 % {len(_PARTS)} + 1] || ' ' || {sql.words(_ENDS)}[doc_id % 10009 % {len(_ENDS)} + 1] AS m FROM documents"
_FACTUAL = lambda c: f"({_any(c, routing.FACTUAL)} OR (contains({c}, '?') AND {_any(c, routing.ASKING)}))"
_rank = lambda t, k: f"SELECT q AS item_id, doc AS doc_id, s AS score, rank FROM (SELECT q, doc, round(s, 6) AS s, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, doc) AS rank FROM {t}) WHERE rank <= {k}"
_flat = lambda c: f"regexp_replace(lower({sql.fold(c)}), '[^a-z0-9]', '', 'g')"
_TRI = "list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))"

ORACLE_SQL = {
    "index_terms": f"WITH RECURSIVE {_postings(True)} SELECT term, df, round(idf, 6) AS idf, round(bm25, 6) AS bm25 FROM terms",
    "bm25_top3": f"WITH RECURSIVE {_postings(False)}, {_BM25} {_rank('bm', 3)}",
    "bm25_top1": f"WITH RECURSIVE {_postings(True)}, {_BM25} SELECT item_id, doc_id, score FROM ({_rank('bm', 1)})",
    "tfidf_top3": f"WITH RECURSIVE {_postings(False)}, {_TFIDF} {_rank('lex', 3)}",
    "ppmi_pairs": f"""
        WITH RECURSIVE {_postings(False)}, voc AS (SELECT term FROM terms WHERE df >= 3 AND length(term) >= 3 ORDER BY df DESC, term LIMIT 4000),
             i AS (SELECT doc, term FROM post JOIN voc USING (term)), p AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM i x JOIN i y ON x.doc = y.doc AND x.term <> y.term GROUP BY 1, 2),
             m AS (SELECT a AS t, sum(n) AS c FROM p GROUP BY 1), tt AS (SELECT sum(n) AS c FROM p)
        SELECT a, b, ppmi, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY ppmi DESC, b) AS rank FROM
          (SELECT a, b, round(ln(tt.c * p.n / (ma.c * mb.c)), 6) AS ppmi FROM p JOIN m ma ON ma.t = a JOIN m mb ON mb.t = b, tt WHERE tt.c * p.n > ma.c * mb.c)) WHERE rank <= 5""",
    "pattern_division": f"""
        WITH qq AS (SELECT item_id, list_distinct({_tok}) AS t FROM benchmark), ok AS (SELECT * FROM qq WHERE len(t) >= 2 OR len(list_filter(t, lambda w: length(w) >= 6)) > 0),
             dd AS (SELECT doc_id, {_tok} AS t FROM documents)
        SELECT item_id, min(doc_id) AS doc_id, 0.5::DOUBLE AS score FROM ok JOIN dd ON list_has_all(dd.t, ok.t) GROUP BY 1""",
    "cosine_top5": """
        WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, vec_id, round(s, 3) AS sim FROM p WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id) <= 5""",
    "refresh_plan": """
        SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'drop' WHEN doc_id % 19 = 0 THEN 'add' ELSE 'rebuild' END AS action FROM documents
        WHERE (doc_id % 13 = 0 AND doc_id % 19 <> 0) OR (doc_id % 13 <> 0 AND (doc_id % 19 = 0 OR doc_id % 17 = 0))""",
    "keyword_attention": f"""
        WITH kw AS (SELECT DISTINCT lang || '-' || (doc_id % 7) AS tag, unnest({_tok}) AS stem FROM documents), n AS (SELECT count(DISTINCT tag) AS n FROM kw),
             w AS (SELECT stem, ln(n / (1 + count(*))) AS weight FROM kw, n GROUP BY stem, n), m AS (SELECT DISTINCT item_id, unnest({_tok}) AS stem FROM benchmark),
             s AS (SELECT item_id, tag, round(sum(weight), 9) AS score FROM m JOIN w USING (stem) JOIN kw USING (stem) WHERE weight > 0 GROUP BY 1, 2)
        SELECT item_id, tag, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tag DESC) = 1""",
    "exact_pattern_index": rf"""
        WITH e AS (SELECT DISTINCT 't' || doc_id AS tag, doc_id % 3 <> 0 AS kn, regexp_replace(regexp_replace(lower({sql.fold('text')}), '\s+', ' ', 'g'), '^[?!.,;: ]+|[?!.,;: ]+$', '', 'g') AS key FROM documents),
             g AS (SELECT key, count(DISTINCT tag) AS n, count(*) FILTER (NOT kn) AS c, min(tag) AS t, min(tag) FILTER (NOT kn) AS s FROM e WHERE key <> '' GROUP BY 1)
        SELECT key, CASE WHEN n = 1 THEN t WHEN c = 1 THEN s END AS tag FROM g""",
    "message_kinds": f"""
        WITH RECURSIVE mm AS ({_MESSAGES}), {sql.tokens(search=False, m="SELECT doc_id AS id, m AS text FROM mm")},
        t AS (SELECT doc_id, m, {sql.fold('lower(m)')} AS f, ts FROM mm JOIN m_toks ON id = doc_id)
        SELECT doc_id, CASE WHEN {_any('f', routing.INADEQUACY)} THEN 'inadequacy' WHEN {_any('f', routing.FEEDBACK)} THEN 'feedback'
                 WHEN list_has_any(ts, {sql.words(routing.JOKE_VERBS)}) AND list_has_any(ts, {sql.words(routing.HUMOUR)}) THEN 'joke' WHEN {_any('f', routing.TRUST)} THEN 'trust'
                 WHEN list_has_any(ts, {sql.words(routing.REPEAT)}) AND len(list_filter(ts, lambda w: NOT contains(w, '_') AND NOT list_contains({sql.words(list(dict.fromkeys(STOPWORDS)))}, w))) = 0 AND doc_id % 2 = 0 THEN 'repeat'
                 WHEN {_any('f', routing.ADVICE)} AND NOT {_FACTUAL('f')} AND {_any('f', routing.SENSITIVE)} THEN 'advice' END AS kind,
               {_FACTUAL('f')} AS factual, {_any(f"lower({sql.fold('m')})", routing.KNOWLEDGE)} AS knowledge, doc_id % 3 = 0 AS refusal FROM t""",
    "routes": f"""
        WITH a AS (SELECT doc_id, doc_id * 7 % 20 / 20.0::DOUBLE AS p, doc_id * 7 % 9 / 4.0::DOUBLE AS s, doc_id * 7 % 11 / 10.0::DOUBLE AS sc, list_distinct({_tok}) AS w, {sql.fold("lower(text || CASE WHEN doc_id % 4 = 0 THEN ' nedir' ELSE '' END)")} AS f FROM documents),
             o AS (SELECT *, list_intersect(w, ['the', 'in', 'de', 'la', 'nonesuch']) AS x FROM a),
             c AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN false WHEN s < 0.5 AND p < 0.95 THEN false WHEN p < 0.3 AND s < 1.5 THEN false WHEN doc_id % 5 = 0 AND s < 1.5 AND p < 0.95 THEN false WHEN len(w) = 0 THEN p >= 0.3 OR s >= 1.5
                            WHEN len(x) = 1 AND length(x[1]) <= 3 THEN false WHEN len(x) = 0 THEN p >= 0.95 OR s >= 1.5 ELSE true END AS trusted FROM o)
        SELECT doc_id, trusted, CASE WHEN doc_id % 23 = 0 THEN 'feedback' WHEN trusted AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'classified' WHEN sc >= 0.25 AND doc_id % 2 = 0 THEN 'retrieved'
               WHEN {_FACTUAL('f')} AND doc_id % 3 = 0 THEN 'looked up' ELSE 'unknown' END AS route FROM c""",
    "unknown_subjects": f"""
        WITH RECURSIVE {sql.tokens(search=False, d="SELECT doc_id AS id, text FROM documents", b="SELECT item_id AS id, text FROM benchmark")},
        kw AS (SELECT DISTINCT lang AS tag, unnest(ts) AS stem FROM d_toks JOIN documents ON id = doc_id), kf AS (SELECT * FROM kw WHERE NOT list_contains({sql.words(STOPWORDS)}, stem)), n AS (SELECT count(DISTINCT tag) AS n FROM kf),
        wt AS (SELECT stem, ln(n / (1 + count(*))) AS weight FROM kf, n GROUP BY stem, n),
        ws AS (SELECT DISTINCT id, unnest(ts) AS stem FROM b_toks), lw AS (SELECT * FROM ws WHERE length(stem) >= 4 AND NOT list_contains({sql.words(STOPWORDS)}, stem)),
        v AS (SELECT id, lw.stem, greatest(coalesce(max(a.weight), 0), coalesce(max(b.weight), 0), coalesce(max(c.weight), 0)) AS w,
                     max(a.weight) AS wa, max(b.weight) AS wb, max(c.weight) AS wc FROM lw LEFT JOIN wt a ON a.stem = lw.stem LEFT JOIN wt b ON contains(lw.stem, '_') AND b.stem = regexp_extract(lw.stem, '^(.*)_', 1) LEFT JOIN wt c ON contains(lw.stem, '_') AND c.stem = regexp_extract(lw.stem, '_([^_]*)$', 1) GROUP BY 1, 2)
        SELECT item_id, coalesce(bool_or(v.w <= 0), false) AS unknown FROM (SELECT DISTINCT id AS item_id FROM b_toks) LEFT JOIN v ON v.id = item_id GROUP BY 1""",
    "word_frequency": f"WITH {_WORDS} SELECT word, n FROM f",
    "char_pair_counts": f"WITH {_WORDS}, e AS (SELECT n, unnest(list_transform(range(1, length(word)), lambda i: word[i:i + 1])) AS p FROM f) SELECT p[1:1] AS a, p[2:2] AS b, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2",
    "char_vocabulary": "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1 HAVING count(*) >= 5",
    "markov_transitions": f"""
        WITH s AS (SELECT unnest({sql.sentences('text')}) AS s FROM documents), t AS (SELECT {sql.ascii_tokens('s')} AS w FROM s),
             e AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM t), c AS (SELECT p[1] AS head, p[2] AS next, count(*) AS n FROM e GROUP BY 1, 2),
             h AS (SELECT head, sum(n) AS t FROM c GROUP BY 1)
        SELECT head, next, n FROM c JOIN h USING (head) WHERE t >= 3 AND n >= 2""",
    "fused_search": f"""
        WITH RECURSIVE {_postings(True)}, {_TFIDF},
        titles AS MATERIALIZED (SELECT doc_id AS doc, replace({sql.fold("lower(trim(substring(text, 1, 120)))")}, ' ', '_') AS t FROM documents WHERE trim(substring(text, 1, 120)) <> ''),
        one AS (SELECT q.q, min(doc) AS doc, 0.3 AS b FROM q JOIN titles ON t = term GROUP BY q.q, t),
        bt AS (SELECT item_id AS q, lower({sql.fold('text')}) AS qn, coalesce(ts, []) AS own FROM benchmark LEFT JOIN b_toks ON id = item_id),
        many AS (SELECT q, doc, 0.3 AS b FROM bt JOIN titles ON length(regexp_replace(t, '[^a-z0-9]', '', 'g')) >= 3 AND NOT list_contains(own, t) AND contains(qn, t)
                 AND regexp_matches(qn, '(^|[^a-z0-9])' || regexp_escape(t) || '($|[^a-z0-9])')),
        base AS (SELECT q, doc, sum(s) AS s FROM (SELECT q, doc, s FROM lex UNION ALL SELECT q, doc, b FROM one UNION ALL SELECT q, doc, b FROM many) GROUP BY 1, 2),
        top AS (SELECT q, doc FROM base WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, doc) <= 500),
        qt AS MATERIALIZED (SELECT q, {_TRI} AS g FROM (SELECT item_id AS q, {_flat('text')} AS t FROM benchmark WHERE length(text) >= 6)),
        dt AS MATERIALIZED (SELECT doc, {_TRI} AS g FROM (SELECT doc_id AS doc, {_flat("substring(text, 1, 120) || ' ' || text")} AS t FROM documents)),
        tri AS (SELECT q, doc, 0.35 * len(list_intersect(dt.g, qt.g)) / len(qt.g) AS t FROM top JOIN qt USING (q) JOIN dt USING (doc) WHERE len(qt.g) > 0),
        ranked AS (SELECT q, doc, s + coalesce(t, 0) AS s FROM base LEFT JOIN tri USING (q, doc)),
        low AS (SELECT q FROM ranked GROUP BY 1 HAVING max(s) < 0.8),
        braw AS (SELECT q, doc, sum(bm25 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))) AS raw FROM post JOIN terms USING (term) JOIN q USING (term) JOIN low USING (q) JOIN lens USING (doc), avgd GROUP BY 1, 2),
        bm AS (SELECT q, doc, 0.6 * raw / max(raw) OVER (PARTITION BY q) AS r FROM braw),
        fin AS (SELECT q, doc, round(coalesce(s, 0) + coalesce(r, 0), 6) AS s FROM ranked FULL JOIN bm USING (q, doc))
        SELECT q AS item_id, doc AS doc_id, round(s, 5) AS score FROM fin QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, doc) = 1 AND s >= 0.25""",
}
