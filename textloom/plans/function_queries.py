"""Queries over cleaners, cutters, gates, pair builders and lookups that the other modules don't register."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import gates, text, tokens
from textloom.operators import dedupe, generators, merge, metrics, pairs, routing
from textloom.plans import sql
from textloom.plans.pair_queries import _djb
from textloom.plans.text_queries import table
from textloom.sources import files

_EXTRAS = ["{} ozeti", "{} tarihi", "{} ornekleri", "{} ne ise yarar"]
_VOCABULARY = ["the", "and", "in", "de", "la", "on", "of", "nonesuch"]


def _docs(spark, d):
    return table(spark, d, "documents")


def _first_line(c="text"):
    return F.substring_index(c, "\n", 1)


def text_cleaners(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", text.clean_response(t, 204).alias("response"), text.strip_foreign_scripts(t).alias("own_scripts"), text.printable(t).alias("printable"), text.ascii_letters_only(t).alias("ascii_letters"),
        F.array_join(text.non_latin_letters(t), "").alias("other_letters"), text.decode_spacing(t).alias("spaced"), text.turkish_ascii(t).alias("turkish"),
    )


def text_cutters(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.seq_refine_response(text.clean_chars(t), 204).alias("refined"), text.snippet(t, 300).alias("snippet"), text.short_answer(t).alias("short"), F.array_join(text.clauses(t), "|").alias("clauses"), F.array_join(text.segments(text.ascii_fold(t)), "|").alias("segments"))


def gate_flags(spark, d):
    t, k = F.col("text"), F.col("doc_id")
    neg = generators.negation(t)
    rows = _docs(spark, d).select(
        "doc_id", gates.is_quality_title(_first_line()).alias("title"), gates.passes_thread(k % 7 == 0, k % 20, k % 30).alias("thread"), gates.keeps_corpus_row(t).alias("corpus_row"), neg.alias("n"),
        t.rlike(gates.HARD_PII).alias("personal"), t.rlike(gates.SOFT_PII).alias("handle"),
    )
    return rows.select("doc_id", "title", "thread", "corpus_row", "n.negated", F.array_join(F.array_sort("n.topic"), " ").alias("topic"), "personal", "handle")


def answer_gates(spark, d):
    """Answers against their questions: the first broken rule, of generated text and of rephrased facts, and title anchors."""
    p = pairs.chat_pairs(table(spark, d, "conversations")).withColumns({"a": tokens.ascii_tokens(F.col("resp")), "q": tokens.ascii_tokens(F.col("ctx"))})
    words = F.array(*[F.lit(w) for w in _VOCABULARY])
    return p.select("conv", "turn", gates.generated_gate(F.col("resp"), F.col("a"), F.col("q"), words, tokens.content_terms(F.col("q"))).alias("generated"), gates.rephrase_gate(F.col("resp"), F.col("a"), F.concat(F.col("q"), words)).alias("rephrased"), gates.chunk_anchored(F.col("q"), F.col("a")).alias("anchored"))


def built_pairs(spark, d):
    """Instruction, thinking and question pairs, by kind."""
    docs = _docs(spark, d)
    given = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.lit(" "))
    rows = docs.select("doc_id", _first_line().alias("instruction"), given.alias("input"), F.col("text").alias("output"), F.col("lang").alias("question"))
    out = pairs.instruction_pairs(rows).withColumn("kind", F.lit("instruction"))
    out = out.unionByName(pairs.thinking_pairs(rows, "question", "input", "output").withColumn("kind", F.lit("thinking")))
    out = out.unionByName(pairs.question_pairs(rows, "instruction", "output").withColumn("kind", F.lit("question")))
    return out.groupBy("kind", "ctx", F.md5("resp").alias("resp")).agg(F.count(F.lit(1)).alias("n"))


def verse_pairs(spark, d):
    """Each document's lines as a poem."""
    return pairs.verse_pairs(_docs(spark, d).select("doc_id", F.concat(F.lit("<poem>"), F.replace("text", F.lit(". "), F.lit("\n")), F.lit("</poem>")).alias("t")), "doc_id", "t").select(F.col("id").alias("doc_id"), "at", "ctx", "resp")


def _intents(spark, d):
    s = text.sentences(F.col("text"))
    return _docs(spark, d).select(F.col("doc_id").alias("ord"), F.concat_ws("_", F.lit("konu"), F.col("doc_id").cast("string")).alias("tag"), F.slice(s, 1, 6).alias("patterns"), s.alias("responses"), F.when(F.col("doc_id") % 4 == 0, "sohbet").alias("kind"))


def intent_training_pairs(spark, d):
    return pairs.intent_pairs(_intents(spark, d)).select("ord", "ctx", "resp")


def intent_builders(spark, d):
    """Seed chunks and question patterns of the documents as intents."""
    chunks = generators.seed_chunks(_intents(spark, d)).select("id", "title", F.md5("text").alias("text"), F.md5("patterns").alias("patterns"))
    topics = _docs(spark, d).select(F.concat_ws("_", F.lit("konu"), F.col("doc_id").cast("string")).alias("id"), F.array_join(generators.generated_patterns(F.concat_ws(" ", "source", F.col("doc_id").cast("string")), _EXTRAS, 3), "|").alias("asked"))
    return topics.join(chunks, "id", "left")


def knowledge_lookups(spark, d):
    known = _docs(spark, d).select(F.col("doc_id").alias("ord"), _first_line().alias("ctx"), F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("value"))
    asked = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("the "), F.col("text"))).alias("m"))
    return routing.knowledge_lookup(asked, "m", known).select("item_id", "knowledge")


def completions(spark, d):
    return routing.autocomplete(_docs(spark, d).select(F.lower(_first_line()).alias("line")), "line", "de", 6)


def encoded_examples(spark, d):
    """Padded examples, places in a vocabulary and 0/1 vectors of chat pairs."""
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    codes = lambda c: F.transform(tokens.ascii_tokens(F.col(c)), lambda w: F.length(w))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    own = tokens.ascii_tokens(F.col("resp"))
    return p.select("conv", "turn", ids(pairs.padded_example(codes("ctx"), codes("resp"), codes("resp"), 64)).alias("example"), ids(tokens.padded_indices(own, _VOCABULARY, 12)).alias("places"), ids(tokens.one_hot(own, _VOCABULARY)).alias("hot"))


def overlaps(spark, d):
    p = pairs.chat_pairs(table(spark, d, "conversations")).withColumns({"a": tokens.eval_tokens(F.col("resp")), "q": tokens.eval_tokens(F.col("ctx"))})
    a, q = F.col("a"), F.col("q")
    return p.select("conv", "turn", F.round(metrics.fidelity(a, q), 6).alias("fidelity"), F.round(metrics.copy_overlap(a, q), 6).alias("copied"), F.round(dedupe.jaccard(F.array_distinct(a), F.array_distinct(q)), 6).alias("jaccard"))


def upserted(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).otherwise(" ").alias("key"), "event_id", F.round("value", 6).alias("value"))
    return merge.upsert(e.where("event_id % 5 = 0"), e.where("event_id % 5 <> 0"), "key", "event_id").select("key", "event_id", "value", "added")


def merged_lists(spark, d):
    rows = _docs(spark, d).select("lang", "doc_id", F.array("source", F.concat("source", F.lit("x")), F.col("lang")).alias("xs"))
    return merge.merge_lists(rows, "lang", "doc_id", ["xs"]).select("lang", F.array_join("xs", ",").alias("xs"))


def intent_violations(spark, d):
    return files.intent_violations(_intents(spark, d).withColumn("tag", F.when(F.col("ord") % 50 == 0, F.lit("é")).otherwise(F.col("tag"))))


def classified(spark, d):
    p, s, own = (F.col("doc_id") % 20) / 20.0, (F.col("doc_id") % 7) / 3.0, (F.col("doc_id") % 5) / 4.0
    return _docs(spark, d).select("doc_id", routing.classify(p, F.when(F.col("doc_id") % 7 > 0, s), own, F.col("lang"), F.col("source")).alias("tag"))


QUERIES = {f.__name__: f for f in (text_cleaners, text_cutters, gate_flags, answer_gates, built_pairs, verse_pairs, intent_training_pairs, intent_builders, knowledge_lookups, completions, encoded_examples, overlaps, upserted, merged_lists, intent_violations, classified)}

_W = sql.SPACES
_strip = lambda c: f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"
_squeeze = lambda c: f"regexp_replace({c}, '{_W}{{2,}}', ' ', 'g')"
_line = "string_split(text, chr(10))[1]"
_few = lambda l: f"(len({l}) < 6 OR len(list_distinct({l})) < least(12, floor(len({l}) * 0.3)))"
_stutter = lambda t: f"(len({t}) >= 4 AND len(list_filter(range(1, len({t})), lambda i: {t}[i] = {t}[i + 1])) / (len({t}) - 1) > 0.5)"
_foreign = lambda c: f"(trim(coalesce({c}, '')) <> '' AND ({sql.latin_share(c)} < 0.5 OR {sql.stop_share(c, tokens.STOP_TR)} - {sql.stop_share(c, tokens.STOP_EN)} < -0.08))"
_exam = lambda c: rf"(len(regexp_extract_all({sql.clean(c)}, '\( *\)')) >= 2 OR len(regexp_extract_all({sql.clean(c)}, '(?:^| )[a-e]\)')) >= 2)"
_INTENTS = f"SELECT doc_id AS ord, 'konu_' || doc_id AS tag, list_slice({sql.sentences('text')}, 1, 6) AS patterns, {sql.sentences('text')} AS responses, CASE WHEN doc_id % 4 = 0 THEN 'sohbet' END AS kind FROM documents"
_templates = lambda topic: "[" + ", ".join(f"replace('{t}', '{{}}', {topic})" for t in generators.TEMPLATES) + "]"

ORACLE_SQL = {
    "text_cleaners": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
             a AS (SELECT *, array_to_string(list_filter(string_split(x, ''), lambda c: NOT (unicode(c) > 127 AND regexp_matches(c, '\p{{L}}'))), '') AS l FROM t)
        SELECT doc_id, {sql.response('x', 204)} AS response, {_strip(_squeeze(f"regexp_replace(x, '{sql.FOREIGN}', ' ', 'g')"))} AS own_scripts,
               {_strip(f"substring(regexp_replace(regexp_replace(x, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g'), '{_W}+', ' ', 'g'), 1, 300)")} AS printable, nullif({_strip(_squeeze('l'))}, '') AS ascii_letters,
               array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(x, '\p{{L}}'), lambda c: unicode(c) > 127))), '') AS other_letters,
               upper(substring({_strip(_sp := r"regexp_replace(regexp_replace(x, ' +([,.;:!?…])', '\1', 'g'), '([,.;:!?…])([\p{L}\p{N}])', '\1 \2', 'g')")}, 1, 1)) || substring({_strip(_sp)}, 2) AS spaced,
               translate(x, 'çğıöşüÇĞİÖŞÜ', 'cgiosucgiosu') AS turkish FROM a""",
    "text_cutters": rf"""
        WITH t AS (SELECT doc_id, {sql.clean('text')} AS c, {_strip(sql.text('text'))} AS s, {_strip(f"regexp_replace({sql.text('text')}, '(?i)\\([^)]*telaffuz[^)]*\\)', '', 'g')")} AS p, {sql.text('text')} AS x FROM documents),
             u AS (SELECT *, regexp_extract(substring(c, 1, 212), '(?s)^(.{{15,}}[.?:!])', 1) AS ce, regexp_extract(substring(s, 1, 300), '(?s)^(.*[.!?])[ \n]', 1) AS se, regexp_extract(substring(s, 1, 300), '(?s)^(.*) ', 1) AS sw, regexp_extract(substring(p, 1, 270), '(?s)^(.*?[.!?])(?: |$)', 1) AS pf FROM t),
             v AS (SELECT *, CASE WHEN length(c) <= 204 THEN c WHEN ce <> '' THEN trim(ce) ELSE trim(substring(c, 1, 204)) END AS o,
                          list_filter(list_transform(regexp_split_to_array({sql.fold('x')}, '(?i)[.,!?;:•]{_W}*|\b(?:{'|'.join(text.CONJUNCTIONS)})\b'), lambda y: {_strip('y')}), lambda y: y <> '') AS g FROM u)
        SELECT doc_id, CASE WHEN length(c) >= 10 THEN CASE WHEN regexp_matches(o, '[.?!]$') THEN o ELSE o || '.' END END AS refined,
               CASE WHEN length(s) <= 300 THEN s WHEN length(se) > 150 THEN se ELSE CASE WHEN sw <> '' THEN sw ELSE substring(s, 1, 300) END || '...' END AS snippet,
               CASE WHEN length(p) <= 150 THEN p WHEN pf <> '' THEN pf ELSE rtrim(substring(p, 1, 150)) || '...' END AS short,
               array_to_string(list_filter(list_transform(regexp_split_to_array(x, '[,;]'), lambda y: {_strip('y')}), lambda y: y <> ''), '|') AS clauses,
               CASE WHEN len(g) > 0 THEN array_to_string(g, '|') ELSE {sql.fold('x')} END AS segments FROM v""",
    "gate_flags": rf"""
        WITH t AS (SELECT doc_id, text AS x, {_line} AS l, {_strip(sql.text('text'))} AS s, list_filter(regexp_split_to_array(lower({sql.fold('text')}), '[ \t\n\x0B\f\r]+'), lambda w: length(w) >= 3) AS ws FROM documents),
             n AS (SELECT *, list_filter(ws, lambda w: list_contains({sql.words(generators.NEGATIVE)}, w) OR (length(w) >= 5 AND regexp_matches(w, '({"|".join(generators.NEGATIVE_ENDINGS)})$'))) AS bad FROM t)
        SELECT doc_id, NOT contains(l, '(') AND len(regexp_split_to_array(trim(l), ' +')) <= 6 AS title, doc_id % 7 <> 0 AND doc_id % 20 >= 8 AND doc_id % 30 >= 10 AS thread,
               NOT (length(s) < 5 OR regexp_matches(s, '\(\s*d\.?\s*$|\(\s*$') OR len(regexp_split_to_array(s, '{_W}+')) <= 1) AND len(regexp_split_to_array(trim(x), '{_W}+')) >= 10 AS corpus_row,
               len(bad) > 0 AS negated, array_to_string(list_sort(list_distinct(list_filter(ws, lambda w: length(w) >= 4 AND NOT list_contains(bad, w)))), ' ') AS topic,
               regexp_matches(x, '{gates.HARD_PII}') AS personal, regexp_matches(x, '{gates.SOFT_PII}') AS handle FROM n""",
    "answer_gates": rf"""
        WITH {sql.RAW_PAIRS}, t AS (SELECT conv, turn, resp AS g, {sql.ascii_tokens('resp')} AS a, {sql.ascii_tokens('ctx')} AS q FROM pairs),
             u AS (SELECT *, list_distinct(a) AS o, regexp_extract_all(lower(g), '\p{{L}}') AS ls, list_distinct(list_concat(q, {sql.words(_VOCABULARY)})) AS kn, list_distinct(list_filter(q, lambda w: length(w) > 1 AND NOT list_contains({sql.words(tokens.STOP_EVAL)}, w))) AS asked FROM t)
        SELECT conv, turn,
               CASE WHEN length(g) < 12 OR length(g) > 260 THEN 'length' WHEN length(g) >= 60 AND NOT regexp_matches(rtrim(g), '[.!?…")]$') THEN 'cut' WHEN {_few('ls')} THEN 'letters' WHEN len(a) < 3 THEN 'words' WHEN list_contains(a, 'eos') THEN 'marker'
                    WHEN len(list_intersect(o, kn)) < 2 OR len(list_intersect(o, kn)) / len(o) < 0.25 THEN 'topic' WHEN len(asked) >= 3 AND NOT list_has_any(o, asked) THEN 'question'
                    WHEN len(list_filter(o, lambda w: NOT list_contains(q, w))) / len(o) < 0.15 THEN 'copied' WHEN {_stutter('a')} THEN 'stutter' END AS generated,
               CASE WHEN length(g) < 12 OR length(g) > 260 THEN 'length' WHEN {_few('ls')} THEN 'letters' WHEN len(a) < 3 THEN 'words' WHEN len(list_intersect(o, kn)) < 2 OR len(list_intersect(o, kn)) / len(o) < 0.2 THEN 'topic'
                    WHEN len(list_filter(o, lambda w: NOT list_contains(kn, w))) / len(o) < 0.15 THEN 'copied' WHEN {_stutter('a')} THEN 'stutter' END AS rephrased,
               list_contains(a, q[1]) AND list_has_all(q, a) AS anchored FROM u""",
    "built_pairs": f"""
        WITH r AS (SELECT {_line} AS l, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN ' ' END AS g, text AS o, lang FROM documents),
             p AS (SELECT 'instruction' AS kind, CASE WHEN trim(coalesce(g, '')) = '' THEN trim(l) ELSE trim(l) || ' | ' || trim(g) END AS ctx, trim(o) AS resp FROM r
                   UNION ALL SELECT 'thinking', trim(lang), trim(o) FROM r UNION ALL SELECT 'thinking', 'dusun: ' || trim(lang), trim(g) || ' ' || trim(o) FROM r WHERE trim(coalesce(g, '')) <> ''
                   UNION ALL SELECT 'question', trim(l), trim(o) FROM r WHERE NOT {_foreign('trim(l)')} AND NOT {_foreign('trim(o)')} AND NOT {_exam('trim(l)')} AND NOT {_exam('trim(o)')})
        SELECT kind, ctx, md5(resp) AS resp, count(*) AS n FROM p WHERE ctx <> '' AND resp <> '' GROUP BY 1, 2, 3""",
    "verse_pairs": f"""
        WITH l AS (SELECT doc_id, regexp_split_to_array(replace(text, '. ', chr(10)), '\\r\\n|\\n|\\r') AS ls FROM documents WHERE NOT contains(text, '<poem>') AND NOT contains(text, '</poem>')),
             e AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS p FROM l), c AS (SELECT doc_id, p, substring({sql.clean('x')}, 1, 400) AS v FROM e), k AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos FROM c WHERE length(v) > 12),
             n AS (SELECT doc_id, pos, lag(v, 2) OVER w || ' ' || lag(v) OVER w AS ctx, v AS resp FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
             m AS (SELECT doc_id, pos, {sql.cut('ctx', 300)} AS ctx, {sql.cut('resp', 300)} AS resp FROM n WHERE pos >= 2)
        SELECT doc_id, pos::INT AS at, ctx, resp FROM m WHERE length(ctx) >= 20 AND length(resp) >= 10""",
    "intent_training_pairs": f"""
        WITH i AS ({_INTENTS}),
             rs AS (SELECT ord, list(v ORDER BY f) AS resps FROM (SELECT ord, v, min(p) AS f FROM (SELECT ord, {sql.response('r', 204)} AS v, p FROM (SELECT ord, unnest(responses) AS r, generate_subscripts(responses, 1) AS p FROM i)) WHERE length(v) >= 6 GROUP BY 1, 2) GROUP BY 1),
             ps AS (SELECT ord, substring({sql.clean('x')}, 1, 48) AS v, p FROM (SELECT ord, unnest(patterns) AS x, generate_subscripts(patterns, 1) AS p FROM i)), good AS (SELECT ord, v AS ctx, row_number() OVER (PARTITION BY ord ORDER BY p) AS p FROM ps WHERE length(v) >= 6),
             cs AS (SELECT * FROM good UNION ALL SELECT ord, substring({sql.clean("replace(tag, '_', ' ')")}, 1, 48), 1 FROM i WHERE ord NOT IN (SELECT ord FROM good)),
             j AS (SELECT ord, ctx, resps, len(patterns) = 6 AND coalesce(kind, '') <> 'sohbet' AS known, p FROM cs JOIN rs USING (ord) JOIN i USING (ord) WHERE ctx <> ''),
             o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY known DESC, ord, p) = 1)
        SELECT ord, ctx, unnest(CASE WHEN known THEN resps ELSE [resps[({_djb('ctx')} % len(resps) + 1)::INT]] END) AS resp FROM o""",
    "intent_builders": f"""
        WITH i AS ({_INTENTS}), c AS (SELECT tag AS id, tag AS title, array_to_string(responses, ' ') AS t, array_to_string(patterns, ' ') AS p FROM i),
             x AS (SELECT 'konu_' || doc_id AS id, source || ' ' || doc_id AS topic FROM documents), y AS (SELECT id, topic, {_templates('topic')} AS a, list_transform({sql.words(_EXTRAS + _EXTRAS)}, lambda e: replace(e, '{{}}', topic)) AS b, ({_djb('topic')} % 4)::INT AS s FROM x)
        SELECT y.id, array_to_string(list_concat(a, list_slice(b, s + 1, s + 3)), '|') AS asked, title, md5(t) AS text, md5(p) AS patterns FROM y LEFT JOIN (SELECT * FROM c WHERE length(t) >= 40) c ON c.id = y.id""",
    "knowledge_lookups": f"""
        WITH k AS (SELECT doc_id AS ord, {_line} AS ctx, lang || '-' || doc_id AS value FROM documents), m AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'the ' || text END AS m FROM benchmark),
             a AS (SELECT ctx AS k1, arg_max(value, ord) AS v1 FROM k GROUP BY 1), b AS (SELECT substring({sql.clean('ctx')}, 1, 64) AS k2, arg_max(value, ord) AS v2 FROM k GROUP BY 1),
             s AS (SELECT item_id, m, v1, v2 FROM m LEFT JOIN a ON m = k1 LEFT JOIN b ON substring({sql.clean('m')}, 1, 64) = k2),
             w AS (SELECT ord, value, unnest(list_distinct({sql.ascii_tokens('ctx')})) AS w FROM k), q AS (SELECT item_id, unnest(list_distinct({sql.ascii_tokens('m')})) AS w FROM s WHERE v1 IS NULL AND v2 IS NULL),
             h AS (SELECT item_id, ord, value, count(*) AS n FROM q JOIN w USING (w) GROUP BY 1, 2, 3 HAVING count(*) >= 2), t AS (SELECT item_id, arg_max(value, n * 10000000 - ord) AS v3 FROM h GROUP BY 1)
        SELECT item_id, coalesce(v1, v2, v3) AS knowledge FROM s LEFT JOIN t USING (item_id)""",
    "completions": f"SELECT DISTINCT lower({_line}) AS line FROM documents WHERE contains(lower({_line}), 'de') ORDER BY NOT starts_with(line, 'de'), line LIMIT 6",
    "encoded_examples": f"""
        WITH {sql.RAW_PAIRS}, t AS (SELECT conv, turn, list_transform({sql.ascii_tokens('ctx')}, lambda w: length(w)) AS c, list_transform({sql.ascii_tokens('resp')}, lambda w: length(w)) AS r, {sql.ascii_tokens('resp')} AS a FROM pairs),
             e AS (SELECT *, list_concat(list_concat(list_concat([1], c), list_slice(r, 1, greatest(8, 64 - len(c) - 8))), list_concat(list_concat([3], r), [2])) AS x, list_transform(list_filter(a, lambda w: list_contains({sql.words(_VOCABULARY)}, w)), lambda w: list_position({sql.words(_VOCABULARY)}, w) - 1) AS k FROM t)
        SELECT conv, turn, array_to_string(list_slice(list_concat(x, list_transform(range(64), lambda i: 0)), 1, 64), ',') AS example,
               array_to_string(list_slice(list_concat(k, list_transform(range(12), lambda i: {len(_VOCABULARY)})), 1, 12), ',') AS places, array_to_string(list_transform({sql.words(_VOCABULARY)}, lambda w: list_contains(a, w)::INT), ',') AS hot FROM e""",
    "overlaps": f"""
        WITH {sql.RAW_PAIRS}, t AS (SELECT conv, turn, {sql.eval_tokens('resp')} AS a, {sql.eval_tokens('ctx')} AS q FROM pairs), u AS (SELECT *, list_distinct(a) AS x, list_distinct(q) AS y FROM t)
        SELECT conv, turn, CASE WHEN len(a) > 0 AND len(q) > 0 THEN round(len(list_filter(a, lambda w: list_contains(q, w))) / len(a), 6) END AS fidelity, CASE WHEN len(x) > 0 THEN round(len(list_intersect(x, y)) / len(x), 6) ELSE 0 END AS copied,
               CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) ELSE 0 END AS jaccard FROM u""",
    "upserted": """
        WITH e AS (SELECT CASE WHEN user_id % 9 <> 0 THEN user_id::VARCHAR ELSE ' ' END AS key, event_id, round(value, 6) AS value, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS side FROM events), k AS (SELECT * FROM e WHERE side = 0 OR trim(key) <> '')
        SELECT key, arg_max(event_id, side * 1000000000000 + event_id) AS event_id, arg_max(value, side * 1000000000000 + event_id) AS value, min(side) = 1 AS added FROM k GROUP BY 1""",
    "merged_lists": """
        WITH e AS (SELECT lang, doc_id, unnest([source, source || 'x', lang]) AS v, unnest([1, 2, 3]) AS p FROM documents), f AS (SELECT lang, v, min((doc_id, p)) AS f FROM e GROUP BY 1, 2)
        SELECT lang, string_agg(v, ',' ORDER BY f) AS xs FROM f GROUP BY 1""",
    "intent_violations": f"""
        WITH i AS (SELECT * REPLACE (CASE WHEN ord % 50 = 0 THEN 'é' ELSE tag END AS tag) FROM ({_INTENTS}))
        SELECT count(*) FILTER (length(tag) < 2) AS short_tag, count(tag) - count(DISTINCT tag) AS repeated_tag, count(*) FILTER (tag = 'é') AS non_latin_tag, count(*) FILTER (len(patterns) = 0) AS no_patterns, count(*) FILTER (len(responses) = 0) AS no_responses,
               count(*) FILTER (len(list_filter(responses, lambda r: length(r) < 2)) > 0) AS short_response, count(*) FILTER (len(patterns) < 6) AS few_patterns FROM i""",
    "classified": """
        WITH c AS (SELECT doc_id, lang, source, doc_id % 20 / 20.0::DOUBLE AS p, CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 / 3.0::DOUBLE END AS s, doc_id % 5 / 4.0::DOUBLE AS own FROM documents)
        SELECT doc_id, CASE WHEN coalesce(s, 0) = 0 AND p < 0.15 THEN NULL WHEN s >= 1.5 AND (p < 0.85 OR s >= own + 1) THEN source ELSE lang END AS tag FROM c""",
}
