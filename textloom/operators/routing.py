"""Rule-based routing: exact patterns, keyword attention, trust gates, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ascii_fold, pattern_key
from textloom.functions.tokens import STOPWORDS, topic_words

#: Parts of a folded message that mark its kind (fixed values).
FEEDBACK = ("yalan soyl", "yalan at", "dogru soyl", "sacmal", "yanlis biliy", "yanlis cevap", "kandirm", "dalga gec", "ciddi ol", "durst ol", "bos konus", "gerceg soyl", "inanm")
INADEQUACY = (
    "hicbir sey bilmiyor", "hicbirsey bilmiyor", "bir sey bilmiyor", "birsey bilmiyor", "hicbir sey bilemiyor", "hicbirsey bilemiyor", "bilmiyorsun", "yetersizsin", "yetersizsiniz",
    "ise yaramaz", "ise yaramiyor", "beceriksiz", "cok kotu biliyorsun", "salaksin", "akilli degilsin", "beyinsiz", "boylesini bile bilmiyorsun",
)
TRUST = (
    "guvenebilir miyim", "guvenebilir miyiz", "guvenilir misin", "guvenebilir misin", "guvenir misin", "sana guven", "sen kimsin", "kimsin", "kim oldugunu soyle", "kendini tanit",
    "kendini anlat",
)
ADVICE = ("sence", "yapayim mi", "benim icin", "adima karar ver")
SENSITIVE = (
    "saglik", "hasta", "hastal", "doktor", "tedavi", "ilac", "ameliyat", "teshis", "diyet", "kilo", "kalp", "tansiyon", "seker", "depresyon", "anksiyete", "kaygi", "kanser", "sigara",
    "alkol", "hamile", "gebelik", "hapis", "ceza", "hukuk", "avukat", "dava", "mahkeme", "suclu",
)
FACTUAL = (
    "nedir", "ne demek", "hakkinda", "kimdir", "kimlerdir", "nerede", "ne zaman", "nasil yapilir", "kac yil", "tarihi", "ozetle", "acikla", "tanimi", "tanim", "anlami", "kaynak",
    "wikipedia", "yapilir misin", "verebilir misin", "ulkede", "ulkesinde", "ulkesi", "sehirde", "neresinde", "ilcesi", "bolgesinde", "kim kurdu", "kim yazdi", "kim buldu",
)
ASKING = (" ne ", " kim ", " nerede ", " nasil ", " kac ", " hangi ", " neden ")
KNOWLEDGE = (
    "nedir", "ne demek", "ne demektir", "hakkinda bilgi", "hakkinda bil", "kimdir", "kimlerdir", "nerede", "neredir", "ne zaman", "anlami nedir", "acilimi", "tarihcesi", "tarihi nedir",
    "konusu nedir", "hangisi", "hangisidir", "hangi biri", "hangi bir", "kac ", "kactir", "kac yil", "kac gun", "kac kisi", "kac metre", "kac kilometre", "kac nufus", "yilinda", "yili",
    "kacindir", "hangi yil", "nasil olur", "nasil calisir", "nasil yapilir", "nasil kuruldu", "kimse", "nerelidir", "yururluk", "sonucu ne", "farki ne",
)
#: Stems: verbs and nouns of a wish for a joke, words of a wish for more (fixed values).
JOKE_VERBS = ("yap", "anlat", "soyle", "uydur", "yaz")
HUMOUR = ("mizah", "espri", "fikra", "saka")
REPEAT = ("daha", "tane", "baska", "bir")
REFUSAL = "bu konuda bilgim yok"


def pattern_index(intents: DataFrame) -> DataFrame:
    """``key, tag`` of an exact pattern; a key of several tags goes to its only chat tag, or to none.

    ``intents`` has ``tag, patterns, knowledge``.
    """
    each = intents.select("tag", "knowledge", F.explode("patterns").alias("p")).select("tag", "knowledge", pattern_key(F.col("p")).alias("key")).where("key <> ''").distinct()
    by = each.groupBy("key").agg(F.count_distinct("tag").alias("n"), F.min("tag").alias("any_tag"), F.count_if(~F.col("knowledge")).alias("n_chat"), F.min(F.when(~F.col("knowledge"), F.col("tag"))).alias("chat"))
    return by.select("key", F.when(F.col("n") == 1, F.col("any_tag")).when(F.col("n_chat") == 1, F.col("chat")).alias("tag"))


def exact_route(messages: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """Messages with the tag of their exact pattern, null if there is none."""
    return messages.withColumn("__key", pattern_key(F.col(text))).join(index.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def keyword_weights(keywords: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """``stem, weight``: ln(tags / (1 + tags with the stem)); stop words weigh nothing."""
    n = keywords.select("tag").distinct().count()
    df = keywords.select("tag", "stem").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    w = F.ln(F.lit(float(n)) / (1 + F.col("df")))
    return df.select("stem", F.when(F.col("stem").isin(stop or []), F.lit(0.0)).otherwise(w).alias("weight"))


def attention(words: DataFrame, keywords: DataFrame, weights: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``q, tag, score``: summed positive weights of the query words (``q, stem``) that a tag has."""
    asked = words.select("q", "stem").distinct()
    if excluded is not None:
        asked = asked.join(excluded.select("q", "stem"), ["q", "stem"], "left_anti")
    hot = keywords.select("tag", "stem").distinct().join(weights.where("weight > 0"), "stem")
    return asked.join(hot, "stem").groupBy("q", "tag").agg(F.sum("weight").alias("score"))


def top_tag(scores: DataFrame, ranks: DataFrame) -> DataFrame:
    """The best tag of each query; of equals the one with the largest rank (``tag, rank``)."""
    ranked = scores.withColumn("score", F.round("score", 9)).join(ranks, "tag")
    return ranked.groupBy("q").agg(F.max(F.struct("score", "rank", "tag")).alias("m")).select("q", "m.tag", "m.score")


def select_knowledge(scores: DataFrame, ranks: DataFrame, credible: DataFrame, least: float = 1.5) -> DataFrame:
    """The best credible knowledge tag of each query with a score of at least ``least``.

    ``credible`` has ``q, tag, shared, tag_words``: a shared content word, and half of the tag's.
    """
    ok = credible.where((F.col("shared") >= 1) & (F.col("shared") >= 0.5 * F.col("tag_words"))).select("q", "tag")
    return top_tag(scores.where(F.col("score") >= least).join(ok, ["q", "tag"], "left_semi"), ranks)


def classify(probability: Column, attention_: Column, own_attention: Column, tag: Column, top: Column) -> Column:
    """The classifier's tag, overridden by strong attention; unclear without either."""
    override = (attention_ >= 1.5) & ((probability < 0.85) | (attention_ >= own_attention + 1))
    unclear = (F.coalesce(attention_, F.lit(0.0)) == 0) & (probability < 0.15)
    return F.when(unclear, F.lit(None).cast("string")).when(override, top).otherwise(tag)


def _words(values) -> Column:
    return F.array(*[F.lit(w) for w in values])


def can_answer(unclear: Column, probability: Column, strength: Column, unknown: Column, asked: Column, known: Column) -> Column:
    """Whether the classified answer may be given.

    ``strength`` is the best keyword attention, ``unknown`` whether a word has no weight
    anywhere, ``asked`` the message's tokens without stop words, ``known`` the tag's keywords.
    """
    shared = F.array_intersect(asked, known)
    n = F.size(shared)
    return (
        F.when(unclear, False)
        .when((strength < 0.5) & (probability < 0.95), False)
        .when((probability < 0.30) & (strength < 1.5), False)
        .when(unknown & (strength < 1.5) & (probability < 0.95), False)
        .when(F.size(asked) == 0, (probability >= 0.30) | (strength >= 1.5))
        .when((n == 1) & (F.length(F.get(shared, F.lit(0))) <= 3), False)
        .when(n == 0, (probability >= 0.95) | (strength >= 1.5))
        .otherwise(True)
    )


def unknown_subject(words: DataFrame, weights: DataFrame) -> DataFrame:
    """``q, unknown``: whether a token (``q, stem``) of four letters that is no stop word has no weight.

    A bigram of which one part has weight is known. ``weights`` has each stem once.
    """
    parts = words.select("q", "stem").distinct().where((F.length("stem") >= 4) & ~F.col("stem").isin(STOPWORDS))
    parts = parts.select("q", "stem", F.explode(F.when(F.contains("stem", F.lit("_")), F.array("stem", F.regexp_extract("stem", "^(.*)_", 1), F.regexp_extract("stem", "_([^_]*)$", 1))).otherwise(F.array("stem"))).alias("part"))
    weighed = parts.join(weights.select(F.col("stem").alias("part"), "weight"), "part", "left").groupBy("q", "stem").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w"))
    found = weighed.groupBy("q").agg(F.bool_or(F.col("w") <= 0).alias("unknown"))
    return words.select("q").distinct().join(found, "q", "left").select("q", F.coalesce("unknown", F.lit(False)).alias("unknown"))


def folded(c: Column) -> Column:
    return ascii_fold(F.lower(F.coalesce(c, F.lit(""))))


def is_refusal(c: Column) -> Column:
    """The folded text, spaces collapsed, begins as a refusal does."""
    return F.startswith(F.trim(F.regexp_replace(folded(c), r"\s+", " ")), F.lit(REFUSAL))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def is_factual(message: Column) -> Column:
    """Asks for a fact: a marker, or a question mark with a question word inside."""
    t = folded(message)
    return _any(t, FACTUAL) | (F.contains(t, F.lit("?")) & _any(t, ASKING))


def is_knowledge_question(message: Column) -> Column:
    return _any(F.lower(ascii_fold(F.coalesce(message, F.lit("")))), KNOWLEDGE)


def is_advice(message: Column) -> Column:
    """Asks for a personal decision on a sensitive topic, and for no fact."""
    t = folded(message)
    return _any(t, ADVICE) & ~is_factual(message) & _any(t, SENSITIVE)


def is_joke(stems: Column) -> Column:
    return F.arrays_overlap(stems, _words(JOKE_VERBS)) & F.arrays_overlap(stems, _words(HUMOUR))


def is_repeat(stems: Column, weightless: Column) -> Column:
    """A word of wishing more, and no single word but those known to weigh nothing (``weightless``)."""
    single = F.filter(stems, lambda w: ~F.contains(w, F.lit("_")))
    return F.arrays_overlap(stems, _words(REPEAT)) & (F.size(F.array_except(single, weightless)) == 0)


def message_kind(message: Column, stems: Column, weightless: Column, last_joke: Column) -> Column:
    """Which fixed handling a message gets, or null; ``last_joke``: the last answer was a joke."""
    t = folded(message)
    out = F.when(_any(t, INADEQUACY), "inadequacy").when(_any(t, FEEDBACK), "feedback").when(is_joke(stems), "joke").when(_any(t, TRUST), "trust")
    return out.when(is_repeat(stems, weightless) & F.coalesce(last_joke, F.lit(False)), "repeat").when(is_advice(message), "advice")


def shares_topic(asked: Column, answers: Column, tag: Column, keywords: Column) -> Column:
    """A topic word of the question is one of the tag's answers, name or keywords (token arrays)."""
    return F.arrays_overlap(topic_words(asked), topic_words(F.concat(answers, tag, keywords)))


def credible_tag(asked: Column, tag: Column) -> Column:
    """A topic word is shared, and half of the tag's topic words are asked for (token arrays)."""
    own = topic_words(tag)
    shared = F.size(F.array_intersect(topic_words(asked), own))
    return (shared >= 1) & (shared / F.size(own) >= 0.5)


def fallback(message: Column, score: Column, anchored: Column, found: Column, least: float = 0.25) -> Column:
    """Where an answer comes from that the classes can't give: the corpus, outside knowledge, or nowhere."""
    corpus = F.coalesce((score >= least) & anchored, F.lit(False))
    return F.when(corpus, "retrieved").when(is_factual(message) & found, "looked up").otherwise("unknown")


def route(kind: Column, trusted: Column, unknown: Column, refused: Column, fallback_: Column) -> Column:
    """A message's way: its fixed handling, the trusted class unless its answer is a refusal, or the fallback."""
    return F.coalesce(kind, F.when(trusted & ~unknown & ~refused, F.lit("classified")).otherwise(fallback_))


def decide(kind: Column, exact: Column, knowledge: Column, trusted: Column, retrieved: Column) -> Column:
    """The answer's source within the classes: special kinds, exact pattern, credible knowledge, trusted class, retrieval, unknown."""
    return F.coalesce(kind, F.when(exact.isNotNull(), "exact").when(knowledge.isNotNull(), "knowledge").when(trusted, "classified").when(retrieved.isNotNull(), "retrieved").otherwise("unknown"))


def knowledge_lookup(messages: DataFrame, text: str, knowledge: DataFrame, width: int = 64, least: int = 2) -> DataFrame:
    """Knowledge of a context: by the text, by its folded beginning, by most shared words.

    ``knowledge`` has ``ord, ctx, value``. The last row wins in the exact steps, the first of the
    best in the last one, for which candidates come from an inverted index.
    """
    from textloom.functions.text import clean_chars
    from textloom.functions.tokens import ascii_tokens

    key = lambda c: clean_chars(F.col(c), width)
    exact = knowledge.groupBy(F.col("ctx").alias("k1")).agg(F.max_by("value", "ord").alias("v1"))
    folded = knowledge.groupBy(key("ctx").alias("k2")).agg(F.max_by("value", "ord").alias("v2"))
    rows = messages.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in messages.columns else messages
    rows = rows.withColumns({"k1": F.col(text), "k2": key(text)}).join(exact, "k1", "left").join(folded, "k2", "left")
    open_ = rows.where("v1 is null and v2 is null").select("k1", F.explode(F.array_distinct(ascii_tokens(F.col(text)))).alias("w")).distinct()
    words = knowledge.select("ord", "value", F.explode(F.array_distinct(ascii_tokens(F.col("ctx")))).alias("w"))
    best = open_.join(words, "w").groupBy("k1", "ord").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")).where(F.col("n") >= least)
    best = best.groupBy("k1").agg(F.max_by("value", F.struct("n", -F.col("ord"))).alias("v3"))
    return rows.join(best, "k1", "left").withColumn("knowledge", F.coalesce("v1", "v2", "v3")).drop("k1", "k2", "v1", "v2", "v3", "__id")


def autocomplete(patterns: DataFrame, column: str, typed: str, k: int = 6) -> DataFrame:
    """Patterns with the typed text, those that begin with it first."""
    p = F.lower(F.col(column))
    hit = patterns.where(F.contains(p, F.lit(typed.lower()))).select(column).distinct()
    return hit.orderBy(~F.startswith(F.lower(F.col(column)), F.lit(typed.lower())), column).limit(k)
