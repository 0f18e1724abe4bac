"""Tokens, n-grams, trigram sets and the suffix stemmer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import WHITE, ascii_fold, let

EVAL_TOKEN = r"([a-zçğıöşü0-9]+)"
#: Word lists (fixed values); each consumer has its own.
STOP_EVAL = "bu su o bir ve ile icin kac hangi nasil ne neden niye ama da de daha en var yok mi mu gibi dahi ya he ben sen biz siz onlar benim senin onun bizim sizin beni bana seni sana ona onu lutfen evet hayir tamam olur peki cok sonra once iste ki ancak hem eger yoksa ayni baska sey e mis".split()
STOP_TR = "bir ve bu da de ile icin cok daha olarak gibi kadar sonra ancak ise ya her ne ben sen biz siz onlar olan var yok nasil neden nerede hangi sey zaman ayni fakat cunku uzeri gore tarafindan once artik hem mi mu ki".split()
STOP_EN = "the and you your that this for with are was have not but can what how when where why does do is it in on at to of my we our they their there here would could should will about from by as if or me him she he us am been being has had were".split()
#: Words that carry no topic, words too general to prove one, words of question patterns, and words left out of a search (fixed values).
STOPWORDS = (
    "mi mu miyim misin misiniz msin msiniz sen ben bana sana bu su neyi hangisi ne hangi kac nasil neden nicin bir da de ya ki miydi midir neydi var yok baska tane daha "
    "zam kurult hakk bilk ver bilg anlat soyle kal olur olabilir edebil eder onerr oner nere neres hank hangis kim kimt ney nered kimi kimin neyi nic ned neye nerde nerdey "
    "edil yapil yapilir yap miy sence bence ile icin gibi kadar cok hic biraz az en once sonra zaman simdi bugun yarin dun acaba sanki peki ama ve ancak cunku ayrica belki "
    "biz siz onlar onun bunun sunun birsey sey miyiz miyuz miyim muyuz muyum musun bende"
).split()
WEAK_WORDS = (
    "buyuk kucuk sehir yer yil gun ay saat dakika isim ad sey konu soru bilgi tarih sayi is tur dil ulke kisi insan yontem sekil turler cesit farkli ayni yeni eski iyi kötü guzel "
    "en cok az ilk son ana temel genel ozel kendisi kendine biz siz onlar her cogu hepsi"
).split()
QUESTION_WORDS = "nedir kimdir kactir nerede hakkinda bilgi ver anlat ne demek bana mi mu".split()
STOP_QUERY = (
    "nedir ne neydi nedi kimdir kim nasil neden nicin nerede hakkinda bilgi ver soyle anlat konus ogret yaz bana ben sen bu su bir mi mu degil acikla detay icer ban beraber "
    "soruyorum merak ediyorum istedim ilet amonle acayip coo sey hani her seyn bagir mr ly any velo cam asiri var hangi ulkede ulkesinde ulkelerde sehirde neresinde ilcesi neye kime "
    "neresi neres kac udur dir nufus komsu"
).split()
#: Suffixes in the order in which they are tried (fixed values).
SUFFIXES = (
    "misiniz miyim musunuz misin lerimiz larimiz leriniz lariniz lerine larina lerin larin lari leri lere lara lar ler "
    "den dan ten tan de da te ta nin nun in un mis mus im um izin uz sin sun i u ecek acak erek arak mel mal mek mak "
    "iyor uyor yor ir ar er en an ye ya yi yle yla ken"
).split()


def stem_word(word: str) -> str:
    """Strip the first fitting suffix again and again while three letters stay, then devoice the end."""
    while True:
        cut = next((s for s in SUFFIXES if len(word) - len(s) >= 3 and word.endswith(s) and not ("miy" in word and s.startswith("mi"))), None)
        if cut is None:
            break
        word = word[: -len(cut)]
    return word[:-1] + {"g": "k", "b": "p", "d": "t"}[word[-1]] if len(word) >= 4 and word[-1] in "gbd" else word


def stem_series(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


class _Stems(dict):
    """Words to stems; bounded, filled on demand."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = stem_word(word)
        return found


def stem_words(words: Column) -> Column:
    """The stems of an array of words, in Arrow batches; each worker stems a word once."""

    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Stems()
        for batch in batches:
            yield batch.map(lambda ws: [known[w] for w in ws], na_action="ignore")

    return stems(words)


def stemmed(words: DataFrame, word_col: str = "word") -> DataFrame:
    """``word, stem`` for each distinct word; the Arrow function sees every word once."""
    return words.select(F.col(word_col).alias("word")).where("word is not null").distinct().withColumn("stem", F.pandas_udf(stem_series, "string")("word"))


def plain_words(c: Column) -> Column:
    """Lower case, folded, ASCII punctuation deleted, split at spaces."""
    t = F.regexp_replace(ascii_fold(F.lower(F.coalesce(c, F.lit("")))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(t, rf"{WHITE}+"), lambda w: w != "")


def eval_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(EVAL_TOKEN), 1)


def ascii_tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded lower-case text."""
    return F.regexp_extract_all(F.lower(ascii_fold(c)), F.lit(r"([a-z0-9]+)"), 1)


def content_terms(tokens: Column, stop: list[str] = STOP_EVAL, longer_than: int = 1) -> Column:
    words = F.array(*[F.lit(w) for w in stop])
    return F.filter(tokens, lambda w: (F.length(w) > longer_than) & ~F.array_contains(words, w))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by single spaces; none if there are fewer words."""

    def made(t: Column) -> Column:
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    return let(tokens, made)


def trigram_set(c: Column) -> Column:
    """Distinct character trigrams of the folded letters and digits."""

    def made(t: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(t, F.lit("(?=(...))"), 1))

    return let(F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9]", ""), made)


def with_bigrams(stems: Column, stop: list[str]) -> Column:
    """Stems followed by the pairs of neighbours that are both content words of four letters."""
    words = F.array(*[F.lit(w) for w in stop])
    good = lambda w: (F.length(w) >= 4) & ~F.array_contains(words, w)
    n = F.greatest(F.size(stems) - 1, F.lit(0))
    both = F.zip_with(F.slice(stems, F.lit(1), n), F.slice(stems, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(both, lambda p: good(p["a"]) & good(p["b"]))
    return F.concat(stems, F.transform(pairs, lambda p: F.concat_ws("_", p["a"], p["b"])))


def engine_tokens(c: Column) -> Column:
    """What the retrieval engine indexes and looks up: stems and bigrams without stop words."""
    return search_terms(with_bigrams(stem_words(plain_words(c)), STOPWORDS))


def tokenised(docs: DataFrame, id_col: str, text_col: str, stop: list[str]) -> DataFrame:
    """``id, tokens``: stems and bigrams of each text, in its row: no word is shuffled."""
    return docs.select(F.col(id_col).alias("id"), with_bigrams(stem_words(plain_words(F.col(text_col))), stop).alias("tokens"))


def _in(words) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(words)])


def weak_stems() -> list[str]:
    """Stems of the words that are too general to prove a topic."""
    return sorted({stem_word(w) for w in WEAK_WORDS})


def search_terms(tokens: Column) -> Column:
    """Tokens (stems and bigrams) without stop words."""
    return F.filter(tokens, lambda w: ~F.array_contains(_in(STOPWORDS), w))


def topic_words(tokens: Column) -> Column:
    """The distinct tokens that carry a topic: no stop words, no general words."""
    return F.array_distinct(F.filter(tokens, lambda w: ~F.array_contains(_in(STOPWORDS + weak_stems()), w)))


def raw_words(c: Column) -> Column:
    """The whole words of a text, in order, that carry a topic and have three letters.

    Stop words go as they are, general words and question patterns also by their stems.
    """
    words = plain_words(c)
    pairs = F.zip_with(words, stem_words(words), lambda w, s: F.struct(w.alias("w"), s.alias("s")))
    stop, dull = _in(STOPWORDS + QUESTION_WORDS), _in([*weak_stems(), *QUESTION_WORDS])
    good = F.filter(pairs, lambda x: ~F.array_contains(stop, x["w"]) & ~F.array_contains(dull, x["s"]) & (F.length(x["w"]) >= 3))
    return F.transform(good, lambda x: x["w"])


def clean_query(c: Column) -> Column:
    """Lower case, the first six words of three letters that say what is searched for."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    kept = F.filter(F.split(t, r"\s+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(_in(STOP_QUERY), w))
    return F.array_join(F.slice(kept, 1, 6), " ")


def djb2(c: Column) -> Column:
    """The string hash h * 33 + code point, from 5381, in 31 bits."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(5381).cast("long"), lambda h, x: (h * 33 + x).bitwiseAND(F.lit(2147483647)))


def one_hot(tokens: Column, vocabulary: list[str]) -> Column:
    """A 0/1 vector over a fixed vocabulary."""
    return F.transform(F.array(*[F.lit(w) for w in vocabulary]), lambda w: F.array_contains(tokens, w).cast("int"))


def padded_indices(tokens: Column, vocabulary: list[str], length: int) -> Column:
    """Vocabulary places of known tokens, cut and padded with the vocabulary's size."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    known = F.transform(F.filter(tokens, lambda w: F.array_contains(words, w)), lambda w: (F.array_position(words, w) - 1).cast("int"))
    return F.slice(F.concat(known, F.array_repeat(F.lit(len(vocabulary)), length)), 1, length)
