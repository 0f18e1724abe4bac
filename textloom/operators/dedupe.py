"""Ordered pair deduplication: the rows that a one-by-one pass in order would keep.

A row is dropped if an earlier kept row has its response, if its context has no words, or if an
earlier kept row's context is similar (Jaccard of word sets). Rows that depend on nobody
undecided are settled in each round, so the result is the sequential one while every step is a
join or a partial aggregate. Equal responses and equal word sets are groups, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import clean_chars
from textloom.storage import materialise


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def word_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(clean_chars(c), " "), lambda w: w != "")))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of keys whose word sets reach the threshold, both directions.

    ``sets`` has ``key, words``. Only the rarest words of a set are indexed: of the larger set as
    many as any similar one must share one of, of the smaller as many as that one must be among.
    A pair meets at its first shared word; what stands before it is lost to the overlap.
    """
    words = sets.select("key", F.explode("words").alias("word"))
    rare = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(rare, "word").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by"))
    n = F.size("by")
    among = 2 * threshold / (1 + threshold)
    prefix = ranked.select("key", n.alias("n"), F.posexplode(F.transform(F.slice("by", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")), lambda x: x)).alias("at", "x"))
    prefix = prefix.where("x.df > 1").select("key", "n", "at", F.col("x.word").alias("word"), (F.col("at") < F.col("n") - F.ceil(F.col("n") * among - 1e-9) + 1).alias("own"))
    prefix = materialise(prefix, "dedupe-prefixes")
    small = prefix.where("own").select("word", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "at")])
    ordered = (F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("key_b") < F.col("key")))
    overlap = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= (F.col("n") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-6
    fits = ordered & (F.col("n_b") >= threshold * F.col("n") - 1e-9) & overlap
    found = prefix.join(small, "word").where(fits).select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct()
    full = found.join(sets.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
    near = full.where(jaccard(F.col("wa"), F.col("wb")) >= threshold).select("a", "b")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def dedupe_pairs(pairs: DataFrame, order: str = "ord", ctx: str = "ctx", resp: str = "resp", threshold: float = 0.9) -> DataFrame:
    """``ord, reason`` for each row: null reason if kept, else response, empty or similar.

    ``ord`` is the row's unique place. Null texts are empty.
    """
    rows = pairs.select(F.col(order).alias("ord"), F.xxhash64(F.coalesce(resp, F.lit(""))).alias("rk"), F.coalesce(resp, F.lit("")).alias("resp"), word_set(F.coalesce(ctx, F.lit(""))).alias("words"))
    rows = rows.select("ord", F.sha2("resp", 256).alias("rk"), F.when(F.size("words") > 0, F.sha2(F.array_join("words", " "), 256)).alias("sk"), "words")
    sets = materialise(rows.where("sk is not null").groupBy(F.col("sk").alias("key")).agg(F.first("words").alias("words")), "dedupe-sets")
    near = materialise(similar_sets(sets, threshold), "dedupe-near")
    state = materialise(rows.where("sk is not null").select("ord", "rk", "sk", F.lit(None).cast("string").alias("reason"), F.lit(False).alias("kept")), "dedupe-state")
    while True:
        open_ = ~F.col("kept") & F.col("reason").isNull()
        firsts = [F.min(F.when(F.col("kept"), F.col("ord"))).alias("k"), F.min(F.when(open_, F.col("ord"))).alias("u")]
        by_resp = state.groupBy("rk").agg(*firsts).select("rk", F.col("k").alias("rk_k"), F.col("u").alias("rk_u"))
        by_set = materialise(state.groupBy("sk").agg(*firsts), "dedupe-sets")
        around = near.join(by_set, near["b"] == by_set["sk"]).groupBy("a").agg(F.min("k").alias("n_k"), F.min("u").alias("n_u")).withColumnRenamed("a", "n_sk")
        seen = state.join(by_resp, "rk").join(by_set, "sk").join(around, F.col("sk") == F.col("n_sk"), "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("ord"), F.lit(False))
        lost = F.when(before("rk_k"), "response").when(before("k") | before("n_k"), "similar")
        waits = before("rk_u") | before("u") | before("n_u")
        state = seen.select("ord", "rk", "sk", F.when(open_, lost).otherwise(F.col("reason")).alias("reason"), F.when(open_, lost.isNull() & ~waits).otherwise(F.col("kept")).alias("kept"))
        state = materialise(state, "dedupe-state")
        if state.where("not kept and reason is null").isEmpty():
            break
    # a row may have been settled by a similar one before its response's first row was
    first_kept = state.where("kept").groupBy("rk").agg(F.min("ord").alias("k"))
    lost = state.where("not kept").select("ord", "rk", F.lit("similar").alias("other")).unionByName(rows.where("sk is null").select("ord", "rk", F.lit("empty").alias("other")))
    named = lost.join(first_kept, "rk", "left").select("ord", F.when(F.coalesce(F.col("k") < F.col("ord"), F.lit(False)), "response").otherwise(F.col("other")).alias("reason"))
    return state.where("kept").select("ord", F.lit(None).cast("string").alias("reason")).unionByName(named)


def dedupe_with_source(pairs: DataFrame, order: str = "ord", ctx: str = "ctx", resp: str = "resp", threshold: float = 0.9) -> DataFrame:
    """The kept rows with all their columns (a source among them); sources are given in order of precedence by ``order``."""
    kept = dedupe_pairs(pairs, order, ctx, resp, threshold).where("reason is null").select(F.col("ord").alias(order))
    return pairs.join(kept, order, "left_semi")


def repeated_answers(answers: DataFrame, group: str, order: str, tokens: str, threshold: float = 0.85) -> DataFrame:
    """Answers that are like an earlier one of their group: ``group, ord, earlier``."""
    a = answers.select(F.col(group).alias("g"), F.col(order).alias("ord"), F.array_distinct(F.col(tokens)).alias("t"))
    b = a.select("g", F.col("ord").alias("o2"), F.col("t").alias("t2"))
    hit = a.join(b, "g").where((F.col("o2") < F.col("ord")) & (jaccard(F.col("t"), F.col("t2")) >= threshold))
    return hit.groupBy("g", "ord").agg(F.min("o2").alias("earlier"))
