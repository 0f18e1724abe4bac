"""Queries over pair building, deduplication, merging and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.gates import HARMFUL
from textloom.functions.text import clean_chars, cut_at_word, sentences
from textloom.functions.tokens import STOP_EN, STOP_TR, ascii_tokens, djb2
from textloom.operators import dedupe, intents, merge, pairs, sampling
from textloom.plans import sql
from textloom.plans.text_queries import table


def chat_pairs(spark, d):
    return pairs.chat_pairs(table(spark, d, "conversations"))


def gated_chat_pairs(spark, d):
    return pairs.gated_pairs(pairs.chat_pairs(table(spark, d, "conversations")), own=STOP_EN, other=STOP_TR)


def training_pairs(spark, d):
    """Cleaned, cut pairs whose context has a space, with their hash."""
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    p = p.select("conv", "turn", cut_at_word(clean_chars(F.col("ctx")), 64).alias("ctx"), cut_at_word(clean_chars(F.col("resp")), 204).alias("resp"))
    return p.where(F.contains("ctx", F.lit(" ")) & (F.length("resp") >= 6)).withColumn("hash", djb2(F.col("ctx")))


def dedupe_documents(spark, d):
    """Ordered dedupe of documents as pairs: the text's first line that isn't blank as context, the text as response."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("resp"), F.substring_index(F.regexp_replace("text", r"^\s+", ""), "\n", 1).alias("ctx"))
    return dedupe.dedupe_pairs(rows)


def keyed_merge_events(spark, d):
    """Latest value of each (user, type) in the place of its first event, over an old and a new half."""
    e = table(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "value")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    out = merge.keyed_merge(old, new, "key", "event_id")
    return out.select("key", "event_id", F.round("value", 6).alias("value"), "added", F.col("place.event_id").alias("first_id"))


def merge_counts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return merge.merge_counts(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "user_id")


def first_wins_text(spark, d):
    docs = table(spark, d, "documents")
    return merge.first_wins(docs.select("doc_id", clean_chars(F.col("text")).alias("key")), ["key"], ["doc_id"]).select("doc_id")


def ordered_source_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    parts = [docs.where(F.col("lang") == x) for x in ("en", "fr", "de", "es")]
    return merge.ordered_sources(parts, clean_chars(F.col("text")), "doc_id").select("doc_id", "source_rank")


def keep_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "value")
    return merge.keyed_merge(e.limit(0), e, "key", "event_id", keep=25).select("key", "event_id", F.round("value", 6).alias("value"))


def anti_join_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return merge.new_rows(docs, table(spark, d, "labels"), "doc_id")


def budgeted_append(spark, d):
    docs = table(spark, d, "documents")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return merge.within_budget(docs, "doc_id", "text", total // 3).select("doc_id")


def drift_diff(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    after = e.where("event_id % 11 <> 0").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return merge.drift(e, after, "event_id", ["user_id", "value"])


def coverage_sample(spark, d):
    p = pairs.chat_pairs(table(spark, d, "conversations")).select(F.col("conv").alias("ctx"), "resp")
    return sampling.coverage_first(p, "ctx", "resp", 150)


def balanced_sample(spark, d):
    return sampling.balanced(table(spark, d, "labels"), "toxic", "doc_id", 60).select("doc_id", "toxic")


def group_split(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return sampling.group_split(c, "conv_id")


def length_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(ascii_tokens(F.col("text"))).alias("n"))
    out = sampling.length_batches(docs, "n", "doc_id", 32)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("width"), F.min("n").alias("least"))


def encoded_pairs(spark, d):
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    codes = lambda c: F.transform(F.split(clean_chars(F.col(c)), ""), lambda x: F.ascii(x))
    ids, mask = pairs.encode_pair(codes("ctx"), codes("resp"))
    p = p.withColumns({"ids": ids, "mask": mask})
    return p.select("conv", "turn", F.size("ids").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_target"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def fingerprint(spark, d):
    c = table(spark, d, "conversations")
    return sampling.fingerprint(c.withColumn("o", F.col("conv_id") * 1000 + F.col("turn")), "o", ["role", "text"])


def conversation_pairs(spark, d):
    """Pairs of the allowed sources; every third conversation counts as one of them."""
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    chats = p.select(F.col("ctx").alias("query"), F.array("resp").alias("answer"), F.when(F.col("conv") % 3 == 0, "seed").otherwise("other").alias("source"))
    return pairs.conversation_pairs(chats, cap=None)


def without_overlap(spark, d):
    p = pairs.chat_pairs(table(spark, d, "conversations"))
    return pairs.without_overlap(p.where("conv % 2 = 0"), p.where("conv % 2 = 1")).select("conv", "turn", "ctx")


def key_sets(spark, d):
    return merge.key_sets(table(spark, d, "documents").where("doc_id % 3 <> 0"), table(spark, d, "labels"), "doc_id")


def _catalogue(spark, d):
    """Documents as intents: language and a number as tag, the first line as pattern, sentences as responses."""
    line = F.substring_index("text", "\n", 1)
    tag = F.concat_ws(" ", F.lit("Könu"), "lang", (F.col("doc_id") % 20).cast("string"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), tag.alias("tag"), F.array(line, line).alias("patterns"), sentences(F.col("text")).alias("responses"))


def intent_catalogue(spark, d):
    c = intents.cleaned_catalogue(_catalogue(spark, d))
    return c.select("ord", "tag", F.size("patterns").alias("n_patterns"), F.size("responses").alias("n_responses"), F.md5(F.array_join("patterns", "|")).alias("patterns"), F.md5(F.array_join("responses", "|")).alias("responses"))


def sourced_dedupe(spark, d):
    """Kept documents with their source: the first line as context, the text as response."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("resp"), F.substring_index(F.regexp_replace("text", r"^\s+", ""), "\n", 1).alias("ctx"), "source")
    return dedupe.dedupe_with_source(docs).select("ord", "source")


QUERIES = {f.__name__: f for f in (conversation_pairs, without_overlap, key_sets, intent_catalogue, sourced_dedupe, chat_pairs, gated_chat_pairs, training_pairs, dedupe_documents, keyed_merge_events, merge_counts, first_wins_text, ordered_source_merge, keep_last, anti_join_ids, budgeted_append, drift_diff, coverage_sample, balanced_sample, group_split, length_batches, encoded_pairs, fingerprint)}

_foreign = lambda c: f"(trim(coalesce({c}, '')) <> '' AND ({sql.latin_share(c)} < 0.5 OR {sql.stop_share(c, STOP_EN)} - {sql.stop_share(c, STOP_TR)} < -0.08))"
_exam = lambda c: rf"(len(regexp_extract_all({sql.clean(c)}, '\( *\)')) >= 2 OR len(regexp_extract_all({sql.clean(c)}, '(?:^| )[a-e]\)')) >= 2)"
_djb = lambda c: f"list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({c}, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (h * 33 + x) & 2147483647)"
_codes = lambda c: f"list_transform(string_split({sql.clean(c)}, ''), lambda x: unicode(x))"

_squeeze = lambda c: f"regexp_replace(regexp_replace({c}, '{sql.SPACES}{{2,}}', ' ', 'g'), '^{sql.SPACES}+|{sql.SPACES}+$', '', 'g')"

ORACLE_SQL = {
    "conversation_pairs": f"""
        WITH {sql.RAW_PAIRS}, c AS (SELECT substring({sql.clean('ctx')}, 1, 64) AS ctx, {sql.response('resp', 204)} AS resp FROM pairs WHERE conv % 3 = 0)
        SELECT DISTINCT ctx, resp FROM c WHERE length(ctx) >= 6 AND length(resp) >= 6""",
    "without_overlap": f"WITH {sql.RAW_PAIRS} SELECT conv, turn, ctx FROM pairs WHERE conv % 2 = 0 AND ctx NOT IN (SELECT ctx FROM pairs WHERE conv % 2 = 1)",
    "key_sets": """
        SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    "intent_catalogue": rf"""
        WITH i AS (SELECT doc_id AS ord, 'konu ' || lang || ' ' || (doc_id % 20) AS tag, string_split(text, chr(10))[1] AS line, {sql.sentences('text')} AS rs FROM documents),
             p AS (SELECT tag, ord, 1 AS pos, {sql.fold(f"regexp_replace(line, '^{sql.SPACES}+|{sql.SPACES}+$', '', 'g')")} AS v FROM i),
             r0 AS (SELECT tag, ord, unnest(rs) AS r, generate_subscripts(rs, 1) AS pos FROM i),
             r1 AS (SELECT tag, ord, pos, {_squeeze(f"regexp_replace(r, '{sql.FOREIGN}', ' ', 'g')")} AS v FROM r0),
             r2 AS (SELECT *, {sql.fold('lower(v)')} AS k FROM r1 WHERE length(v) >= 5 AND NOT regexp_matches(v, '\(\s*d\.?\s*$|\(\s*$') AND len(regexp_split_to_array(v, '{sql.SPACES}+')) >= 3),
             r3 AS (SELECT tag, ord, pos, v FROM r2 QUALIFY row_number() OVER (PARTITION BY ord, k ORDER BY pos) = 1),
             pf AS (SELECT tag, v, min((ord, pos)) AS f FROM p WHERE v <> '' GROUP BY 1, 2), rf AS (SELECT tag, v, min((ord, pos)) AS f FROM r3 GROUP BY 1, 2),
             pp AS (SELECT tag, count(*) AS n_patterns, md5(string_agg(v, '|' ORDER BY f)) AS patterns FROM pf GROUP BY 1), rr AS (SELECT tag, count(*) AS n_responses, md5(string_agg(v, '|' ORDER BY f)) AS responses FROM rf GROUP BY 1)
        SELECT ord, tag, n_patterns, n_responses, patterns, responses FROM (SELECT tag, min(ord) AS ord FROM i GROUP BY 1) JOIN pp USING (tag) JOIN rr USING (tag) WHERE NOT regexp_matches(tag, '{"|".join(HARMFUL)}')""",
    "chat_pairs": f"WITH {sql.RAW_PAIRS} SELECT conv, turn, ctx, resp FROM pairs",
    "gated_chat_pairs": f"WITH {sql.RAW_PAIRS} SELECT conv, turn, ctx, resp FROM pairs WHERE NOT {_foreign('ctx')} AND NOT {_foreign('resp')} AND NOT {_exam('ctx')} AND NOT {_exam('resp')}",
    "training_pairs": f"""
        WITH {sql.RAW_PAIRS}, c AS (SELECT conv, turn, {sql.clean('ctx')} AS a, {sql.clean('resp')} AS b FROM pairs),
             k AS (SELECT conv, turn, {sql.cut('a', 64)} AS ctx, {sql.cut('b', 204)} AS resp FROM c)
        SELECT conv, turn, ctx, resp, {_djb('ctx')} AS hash FROM k WHERE contains(ctx, ' ') AND length(resp) >= 6""",
    "keyed_merge_events": """
        WITH e AS (SELECT user_id || '|' || event_type AS key, event_id, value, event_id % 2 AS side FROM events)
        SELECT key, arg_max(event_id, side * 1000000000000 + event_id) AS event_id, round(arg_max(value, side * 1000000000000 + event_id), 6) AS value,
               min(side) = 1 AS added, arg_min(event_id, side * 1000000000000 + event_id) AS first_id FROM e GROUP BY key""",
    "merge_counts": """
        WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1), o AS (SELECT DISTINCT user_id AS u FROM events WHERE event_id % 3 = 0)
        SELECT coalesce(sum(CASE WHEN u IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS added, coalesce(sum(CASE WHEN u IS NULL THEN n - 1 ELSE n END), 0)::BIGINT AS updated FROM n LEFT JOIN o ON user_id = u""",
    "first_wins_text": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {sql.clean('text')}",
    "ordered_source_merge": f"""
        WITH r AS (SELECT doc_id, list_position(['en', 'fr', 'de', 'es'], lang) - 1 AS source_rank, {sql.clean('text')} AS k FROM documents WHERE lang IN ('en', 'fr', 'de', 'es'))
        SELECT doc_id, source_rank FROM r WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_rank, doc_id) = 1""",
    "keep_last": """
        WITH g AS (SELECT user_id::VARCHAR AS key, min(event_id) AS place, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1)
        SELECT key, event_id, value FROM g ORDER BY place DESC LIMIT 25""",
    "anti_join_ids": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "budgeted_append": """
        WITH r AS (SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(strlen(text)) FROM documents) // 3 AS budget FROM documents)
        SELECT doc_id FROM r WHERE before < budget""",
    "drift_diff": """
        WITH a AS (SELECT event_id, user_id, value FROM events)
        SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS drift FROM a WHERE event_id % 11 = 0 OR event_id % 7 = 0""",
    "coverage_sample": f"""
        WITH {sql.RAW_PAIRS}, k AS (SELECT conv AS ctx, resp, md5('7:' || conv || ':' || resp) AS h FROM pairs),
             r AS (SELECT ctx, resp, h, row_number() OVER (PARTITION BY ctx ORDER BY h, resp) > 1 AS later FROM k)
        SELECT ctx, resp FROM r ORDER BY later, h, ctx, resp LIMIT 150""",
    "balanced_sample": """
        WITH n AS (SELECT least(min(c), 30) AS n FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)),
             r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM labels)
        SELECT doc_id, toxic FROM r, n WHERE rn <= n""",
    "group_split": "SELECT conv_id, turn, CASE WHEN ('0x' || substring(md5('7:' || conv_id), 1, 8))::BIGINT % 100 < 10 THEN 'val' ELSE 'train' END AS split FROM conversations",
    "length_batches": f"""
        WITH l AS (SELECT doc_id, len({sql.ascii_tokens('text')}) AS n FROM documents), r AS (SELECT n, (row_number() OVER (ORDER BY n) - 1) // 32 AS batch FROM l)
        SELECT batch, count(*) AS rows, max(n) AS width, min(n) AS least FROM r GROUP BY 1""",
    "encoded_pairs": f"""
        WITH {sql.RAW_PAIRS}, c AS (SELECT conv, turn, {_codes('ctx')} AS a, {_codes('resp')} AS b FROM pairs)
        SELECT conv, turn, len(a) + len(b) + 3 AS n, len(b) + 1 AS n_target, array_to_string(list_concat([1], list_concat(a, list_concat([3], list_concat(b, [2])))), ',') AS ids FROM c""",
}
