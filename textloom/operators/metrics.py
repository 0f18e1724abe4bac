"""Generation metrics and paired statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import STOP_EVAL, content_terms, eval_tokens, let, ngrams

METRIC_VERSION = 3
METRICS = ("copy_bleu", "copy_prec1", "rep2", "distinct1", "fluency", "topic_q", "topic_k", "topic_mean", "gold_recall", "length_ratio", "avg_word_len", "gen_index", "qa_score")


def numbered(items: Column) -> Column:
    """Each item with its occurrence number: equal multisets become equal sets."""
    return let(F.array_sort(items), lambda xs: F.transform(xs, lambda x, i: F.concat_ws("#", x, (i - F.array_position(xs, x)).cast("string"))))


def clipped_hits(ref: Column, cand: Column) -> Column:
    """Sum over distinct candidate items of the smaller of both counts."""
    return F.size(F.array_intersect(numbered(cand), numbered(ref)))


def bleu(ref: Column, cand: Column, max_n: int = 4, smooth: bool = False) -> Column:
    """Geometric mean of clipped n-gram precisions with the brevity penalty; 0 if one is 0."""
    r, c = F.size(ref), F.size(cand)
    logs, zero, used = [], [], []
    for n in range(1, max_n + 1):
        g, h = ngrams(cand, n), ngrams(ref, n)
        hits, total = clipped_hits(h, g), F.size(g)
        p = (hits + 1.0) / (total + 1.0) if smooth else hits / total
        logs.append(F.when((c >= n) & (p > 0), F.ln(p)).otherwise(0.0))
        zero.append((c >= n) & (p <= 0))
        used.append(F.when(c >= n, 1).otherwise(0))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    bp = F.when(c < r, F.exp(1 - r / F.greatest(c, F.lit(1)))).otherwise(1.0)
    return F.when((c == 0) | reduce(lambda a, b: a | b, zero), 0.0).otherwise(bp * F.exp(add(logs) / add(used)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prec1(ref: Column, cand: Column) -> Column:
    return ratio(clipped_hits(ref, cand), F.size(cand))


def rep_rate(tokens: Column, n: int = 2) -> Column:
    g = ngrams(tokens, n)
    return F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0))


def distinct_ratio(tokens: Column) -> Column:
    return ratio(F.size(F.array_distinct(tokens)), F.size(tokens))


def topic_overlap(cand: Column, ref: Column, stop: list[str] = STOP_EVAL) -> Column:
    own = F.array_distinct(content_terms(cand, stop))
    return ratio(F.size(F.array_intersect(own, content_terms(ref, stop))), F.size(own))


def gold_recall(cand: Column, ref: Column, stop: list[str] = STOP_EVAL) -> Column:
    gold = F.array_distinct(content_terms(ref, stop))
    return ratio(F.size(F.array_intersect(gold, content_terms(cand, stop))), F.size(gold))


def avg_word_len(tokens: Column) -> Column:
    return ratio(F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t)), F.size(tokens))


def fidelity(generated: Column, knowledge: Column) -> Column:
    """Share of generated content words, with repeats, that the knowledge has; null if either is empty."""
    hit = F.size(F.filter(generated, lambda w: F.array_contains(knowledge, w)))
    return F.when((F.size(generated) > 0) & (F.size(knowledge) > 0), hit / F.size(generated))


def copy_overlap(a: Column, b: Column) -> Column:
    own = F.array_distinct(a)
    return ratio(F.size(F.array_intersect(own, b)), F.size(own))


def measure(rows: DataFrame, query: str = "query", gold: str = "gold", generated: str = "generated", knowledge: str | None = None, stop: list[str] = STOP_EVAL) -> DataFrame:
    """All metrics of each row, added to its columns."""
    t = rows.withColumns({"__c": eval_tokens(F.col(generated)), "__r": eval_tokens(F.col(gold)), "__q": eval_tokens(F.col(query))})
    c, r, q = F.col("__c"), F.col("__r"), F.col("__q")
    tk = F.lit(None).cast("double")
    if knowledge:
        kb = eval_tokens(F.col(knowledge))
        tk = F.when(F.size(kb) > 0, topic_overlap(c, kb, stop))
    t = t.withColumns({"copy_bleu": bleu(r, c), "copy_prec1": prec1(r, c), "rep2": rep_rate(c), "distinct1": distinct_ratio(c), "topic_q": topic_overlap(c, q, stop), "topic_k": tk, "gold_recall": gold_recall(c, r, stop), "length_ratio": ratio(F.size(c), F.size(r)), "avg_word_len": avg_word_len(c)})
    t = t.withColumns({"fluency": 0.5 * (1 - F.col("rep2")) + 0.5 * F.col("distinct1"), "topic_mean": F.when(F.col("topic_k").isNotNull(), (F.col("gold_recall") + F.col("topic_k")) / 2).otherwise(F.col("gold_recall"))})
    fit = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.abs(F.col("length_ratio") - 1)))
    empty = F.when(F.size(c) == 0, 1.0).otherwise(0.0)
    t = t.withColumn("gen_index", 0.5 * (1 - F.col("copy_bleu")) + 0.3 * F.col("topic_mean") + 0.2 * F.col("fluency"))
    t = t.withColumn("qa_score", 0.65 * F.col("topic_mean") + 0.25 * F.col("fluency") + 0.05 * F.col("copy_bleu") + 0.05 * fit - 0.5 * empty)
    return t.drop("__c", "__r", "__q")


def usable_hit(accept: Column, expected: Column, predicted: Column, is_class: Column, unclear: str = "Anlayamadim") -> Column:
    """Whether a prediction counts: the expected tag, or for out-of-scope questions no chat class."""
    return F.when(accept == "sohbet_sinifi_DEGIL", ~is_class).when(expected == unclear, predicted == unclear).otherwise(predicted.eqNullSafe(expected))


def hit_rates(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """``n`` and, for each flag, its count and rate by group."""
    counts = [F.count_if(c).alias(f"n_{k}") for k, c in flags.items()]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
    return out.select(*by, "n", *[f"n_{k}" for k in flags], *[(F.col(f"n_{k}") / F.col("n")).alias(f"rate_{k}") for k in flags])


def worst(rows: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """The ``k`` rows of the lowest score; equals by key."""
    return rows.orderBy(F.col(score).asc_nulls_last(), key).limit(k)


def most_common(rows: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values; equals in the order of the values."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def token_accuracy(rows: DataFrame, predicted: str = "predicted", target: str = "target", mask: str = "mask") -> DataFrame:
    """``right, counted, accuracy`` over all rows of token arrays: place i of the prediction is for token i + 1, where the mask at i is set."""
    n = F.least(F.size(predicted), F.size(target) - 1, F.size(mask) - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    counted = F.filter(places, lambda i: F.get(F.col(mask), i) > 0)
    right = F.filter(counted, lambda i: F.get(F.col(predicted), i) == F.get(F.col(target), i + 1))
    sums = rows.select(F.size(right).alias("r"), F.size(counted).alias("c")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("right"), F.coalesce(F.sum("c"), F.lit(0)).alias("counted"))
    return sums.withColumn("accuracy", F.when(F.col("counted") > 0, F.col("right") / F.col("counted")).otherwise(F.lit(0.0)))


def aggregate_report(measured: DataFrame, generated: str = "generated", by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of every metric, and how many outputs are empty."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.size(eval_tokens(F.col(generated))) == 0).alias("n_empty"), F.count("topic_k").alias("n_knowledge")]
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"{m}_std")]
    return measured.groupBy(*(by or [])).agg(*aggs)


def paired_t(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Paired t of ``b - a`` on shared keys: n, mean difference, t, significance. t is 0 without spread."""
    d = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select((F.col("y") - F.col("x")).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("s"))
    se = F.col("s") / F.sqrt("n")
    t = F.when(se > 0, F.col("mean_diff") / se).otherwise(F.lit(0.0))
    return s.select("n", "mean_diff", t.alias("t"), (F.abs(t) >= 2).alias("significant"))


def paired_t_strict(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """As ``paired_t``, but null under two pairs, and infinite for equal nonzero differences."""
    d = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select((F.col("y") - F.col("x")).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    flat = F.when(F.col("m") > 0, F.lit(float("inf"))).when(F.col("m") < 0, F.lit(float("-inf"))).otherwise(0.0)
    return s.select("n", F.when(F.col("n") >= 2, F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(flat)).alias("t"))


def mcnemar(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Discordant counts and the continuity-corrected z of two paired outcomes."""
    s = pairs.agg(F.count_if(~F.col(before) & F.col(after)).alias("b01"), F.count_if(F.col(before) & ~F.col(after)).alias("b10"))
    n = F.col("b01") + F.col("b10")
    return s.select("b01", "b10", F.when(n > 0, (F.abs(F.col("b01") - F.col("b10")) - 1) / F.sqrt(n)).alias("z"))


def compare_reports(a: DataFrame, b: DataFrame, config_a: dict, config_b: dict, key: str = "query", value: str = "qa_score") -> tuple[DataFrame, list[str]]:
    """Paired t of two reports and the settings in which they differ; other metric versions are refused."""
    if config_a.get("metric_version") != config_b.get("metric_version"):
        raise ValueError("reports of different metric versions are not compared")
    return paired_t(a, b, key, value), sorted(k for k in {*config_a, *config_b} if config_a.get(k) != config_b.get(k))


def reason_histogram(rows: DataFrame, reason: str) -> DataFrame:
    """Counts by reason, without what stands in brackets behind it."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.trim(F.substring_index(reason, "(", 1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(candidates: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Accepted rows and share at each threshold, from one pass over the candidates."""
    each = candidates.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(value) >= t).alias("ok")) for t in thresholds])).alias("x"))
    return each.groupBy("x.threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.ok").alias("accepted"))


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, minimum, mean, maximum, deviation, standard error, median and 95th percentile."""
    x = F.col(value)
    return rows.groupBy(*(by or [])).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"),
        (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), F.percentile(x, 0.5).alias("p50"), F.percentile(x, 0.95).alias("p95"),
    )


def case_damage(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Non-ASCII words with capitals, and how many of them folding would turn to lower case."""
    from textloom.functions.text import turkish_ascii

    w = F.col(word)
    seen = tokens.where(w.rlike(r"[^\x00-\x7F]") & w.rlike(r"\p{Lu}"))
    lost = turkish_ascii(w)
    return seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(lost == F.lower(lost)).alias("damaged"))


def rag_context_stats(pairs: DataFrame, knowledge: str = "knowledge") -> DataFrame:
    """Pairs with knowledge, distinct knowledge texts, all pairs."""
    k = F.nullif(F.col(knowledge), F.lit(""))
    return pairs.agg(F.count(k).alias("with_context"), F.count_distinct(k).alias("distinct_context"), F.count(F.lit(1)).alias("pairs"))


def best_of(candidates: DataFrame, group: str, order: str, text: str, accepted: str) -> DataFrame:
    """The longest accepted candidate of each group, the first of equals."""
    ok = candidates.where(F.col(accepted))
    return ok.groupBy(group).agg(F.max_by(text, F.struct(F.length(text), -F.col(order))).alias("best"))


def early_stop(epochs: DataFrame, epoch: str, loss: str, patience: int, val_every: int = 1) -> DataFrame:
    """The epoch with the least loss, and where ``patience`` epochs without a better one have passed."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l"))))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(a: Column, x: Column) -> Column:
        better = x["l"] < a["best"]
        bad = F.when(better, 0).otherwise(a["bad"] + val_every)
        done = a["stop"].isNotNull()
        keep = lambda old, new: F.when(done, old).otherwise(new)
        return F.struct(
            keep(a["best"], F.when(better, x["l"]).otherwise(a["best"])).alias("best"), keep(a["best_epoch"], F.when(better, x["e"].cast("int")).otherwise(a["best_epoch"])).alias("best_epoch"),
            keep(a["bad"], bad).alias("bad"), keep(a["stop"], F.when(bad >= patience, x["e"].cast("int"))).alias("stop"),
        )

    return epochs.agg(F.aggregate(rows, start, step).alias("s")).select("s.best_epoch", F.col("s.stop").alias("stop_epoch"))
