"""Intent tables (``ord, tag, patterns, responses``): cleaning, tag repair, merging, add-ons, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.gates import is_harmful, is_truncated
from textloom.functions.text import WHITE, ascii_fold, ascii_letters_only, clean_chars, non_latin_letters, printable, strip_foreign_scripts
from textloom.functions.tokens import let
from textloom.operators.generators import Paraphraser, paraphrased

MIN_TAG, MIN_WORDS = 3, 3
MAX_ENTRIES, MAX_PATTERNS, MAX_RESPONSES, MAX_CHARS = 20, 20, 10, 300
DEFAULT_RESPONSE = "Faydalı bilgiler edindim!"
_STRINGS = "array<string>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{WHITE}+|{WHITE}+$", "")


def _empty() -> Column:
    return F.array().cast(_STRINGS)


def first_by(values: Column, key) -> Column:
    """The values of an array whose key no earlier value has."""
    kept = lambda xs, ks: F.transform(F.filter(xs, lambda p, i: F.array_position(ks, p["k"]) == i + 1), lambda p: p["v"])
    keyed = F.transform(values, lambda x: F.struct(x.alias("v"), key(x).alias("k")))
    return let(keyed, lambda xs: let(F.transform(xs, lambda p: p["k"]), lambda ks: kept(xs, ks)))


def clean_responses(responses: Column) -> Column:
    """Without foreign scripts, fragments and answers of under three words; of folded equals the first."""
    made = F.transform(F.coalesce(responses, _empty()), lambda r: strip_foreign_scripts(_strip(r)))
    made = F.filter(made, lambda r: ~is_truncated(r) & (F.size(F.split(r, rf"{WHITE}+")) >= MIN_WORDS))
    return first_by(made, lambda r: ascii_fold(F.lower(r)))


def normal_tag(tag: Column) -> Column:
    """Folded lower case without letters beyond ASCII; empty if nothing is left."""
    return F.coalesce(ascii_letters_only(_strip(ascii_fold(F.lower(_strip(tag))))), F.lit(""))


def clean_intents(intents: DataFrame) -> DataFrame:
    """Every intent with its normal tag, folded patterns and clean responses."""
    patterns = F.filter(F.transform(F.coalesce("patterns", _empty()), lambda p: ascii_fold(_strip(p))), lambda p: p != "")
    return intents.select("ord", normal_tag(F.col("tag")).alias("tag"), F.array_distinct(patterns).alias("patterns"), clean_responses(F.col("responses")).alias("responses"))


def _united(rows: DataFrame, key: str = "tag") -> DataFrame:
    """One row for each tag: the smallest ord, and each list's values in order of appearance, once."""
    out = rows.groupBy(key).agg(F.min("ord").alias("ord"))
    for c in ("patterns", "responses"):
        items = rows.select(key, F.col("ord").alias("o"), F.posexplode(c).alias("p", "v")).groupBy(key, "v").agg(F.min(F.struct("o", "p")).alias("at"))
        made = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(c))
        out = out.join(made, key, "left")
    return out.select("ord", key, F.coalesce("patterns", _empty()).alias("patterns"), F.coalesce("responses", _empty()).alias("responses"))


def merge_by_tag(intents: DataFrame) -> DataFrame:
    """One intent for each tag; tags of under three characters or with letters beyond ASCII go."""
    good = (F.length(F.trim("tag")) >= MIN_TAG) & (F.size(non_latin_letters(F.col("tag"))) == 0)
    return _united(intents.where(good))


def cleaned_catalogue(intents: DataFrame) -> DataFrame:
    """The whole cleaning: harmful tags go, the rest is cleaned and merged; empty intents go."""
    kept = intents.where(~is_harmful(F.coalesce("tag", F.lit(""))))
    return merge_by_tag(clean_intents(kept)).where((F.size("patterns") > 0) & (F.size("responses") > 0))


def repaired_tags(intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intents with Latin tags only, merged where a repair meets another tag; and ``tag, repaired`` of those changed or dropped (null)."""
    odd = F.size(non_latin_letters(F.col("tag"))) > 0
    named = intents.withColumn("new", F.when(odd, ascii_letters_only(F.col("tag"))).otherwise(F.col("tag")))
    good = F.coalesce(F.length("new") >= MIN_TAG, F.lit(False))
    kept = _united(named.where(good).select("ord", F.col("new").alias("tag"), "patterns", "responses"))
    return kept, named.where(odd).select("tag", F.when(good, F.col("new")).alias("repaired"))


def with_addons(intents: DataFrame, addons: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Add-only union: new patterns and responses of known tags behind their own; whole new intents behind all.

    Add-ons of unknown tags are skipped, as are new intents whose tag is there.
    """
    known = addons.join(intents.select("tag").distinct(), "tag", "left_semi")
    later = F.lit(intents.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0])
    out = _united(intents.select("ord", "tag", "patterns", "responses").unionByName(known.select((later + 1).alias("ord"), "tag", "patterns", "responses")))
    if new is None:
        return out
    fresh = new.join(intents.select("tag").distinct(), "tag", "left_anti").withColumn("ord", F.col("ord") + later + 1)
    return out.unionByName(_united(fresh.select("ord", "tag", "patterns", "responses")))


def enriched_responses(intents: DataFrame, paraphraser: Paraphraser, k: int = 3) -> DataFrame:
    """Responses followed by their paraphrases whose clean form is new; ``enriched`` is the k that was applied.

    An intent that has a column value ``enriched`` of ``k`` or more stays as it is.
    """
    rows = intents if "enriched" in intents.columns else intents.withColumn("enriched", F.lit(0))
    each = rows.where(F.col("enriched") < k).select("ord", F.posexplode("responses").alias("at", "text"))
    many = paraphrased(each, "text", paraphraser, k).withColumn("key", clean_chars(F.col("text")))
    new = F.struct((F.col("variant") > 0).alias("later"), "at", "variant")
    own = many.where("variant = 0").select("ord", "text", new.alias("place"))
    more = many.where("variant > 0 and key <> ''").join(many.where("variant = 0").select("ord", "key").distinct(), ["ord", "key"], "left_anti")
    more = more.groupBy("ord", "key").agg(F.min_by("text", new).alias("text"), F.min(new).alias("place")).select("ord", "text", "place")
    made = own.unionByName(more).groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("made"))
    return rows.join(made, "ord", "left").select(*[c for c in rows.columns if c not in ("responses", "enriched")], F.coalesce("made", "responses").alias("responses"), F.greatest("enriched", F.lit(k)).alias("enriched"))


def checked_entries(entries: DataFrame) -> DataFrame:
    """``ord, tag, patterns, responses, error``: entries to be learned, cleaned, with the first rule they break, or null.

    Missing responses get a default. If there are more entries than allowed, each has that error.
    """
    tag = F.lower(_strip(F.col("tag")))
    texts = lambda c: F.filter(F.transform(c, lambda x: printable(x, MAX_CHARS)), lambda x: x != "")
    given = F.coalesce("responses", F.array(F.lit(DEFAULT_RESPONSE)))
    error = (
        F.when(F.col("tag").isNull(), "tag missing")
        .when(~tag.rlike(r"^[a-z0-9_]{1,64}$"), "tag invalid")
        .when(F.coalesce(F.size("patterns"), F.lit(0)) <= 0, "no patterns")
        .when(F.size("patterns") > MAX_PATTERNS, "too many patterns")
        .when(F.size(given) == 0, "no responses")
        .when(F.size(given) > MAX_RESPONSES, "too many responses")
        .when((F.size(texts(F.col("patterns"))) == 0) | (F.size(texts(given)) == 0), "empty when cleaned")
    )
    many = entries.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES
    return entries.select("ord", tag.alias("tag"), texts(F.col("patterns")).alias("patterns"), texts(given).alias("responses"), (F.lit("too many entries") if many else error).alias("error"))
