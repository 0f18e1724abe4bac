"""One-to-many builders: intents, chunks, chats, spellings, paraphrases, generated text."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from textloom.functions.gates import is_harmful, line_gate, passes_thread
from textloom.functions.text import ascii_fold, ascii_letters_only, clean_chars, cut_at_word, html_to_text, slug, strip_foreign_scripts, turkish_lower, usable_sentences
from textloom.functions.tokens import STOP_EVAL, ascii_tokens, djb2
from textloom.operators.search import query_blocks, union_all
from textloom.storage import materialise

#: Question templates of a topic (fixed values).
TEMPLATES = ("{} nedir", "{} kimdir", "{} hakkinda bilgi ver", "{} ne demek", "bana {} anlat", "{} nerede")
#: Number words, negative words and negative endings (fixed values).
COUNT_WORDS = {"bir": 1, "iki": 2, "uc": 3, "dort": 4, "bes": 5, "alti": 6, "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10}
NEGATIVE = "degil degilim hayir asla hic yok yoktur nefret olmaz yapma etme gitme gelme isteme sevme verme alma durma konusma soyleme calisma izleme".split()
NEGATIVE_ENDINGS = "meyecegim mayacagim miyordum miyorsunuz miyorsun miyorum miyorlar miyor miyiz miyim meyeceksin mayacaksin meyecek mayacak madim medim madin medin mam mem mazsin mazsun maz mez mayayim meyeyim masan mesin".split()


# --- spelling --------------------------------------------------------------------------------------


def spelling_lexicon(texts: DataFrame, order: str, text: str) -> DataFrame:
    """``key, form``: folded words with the Turkish form they first have; acronyms' keys go."""
    words = texts.select(F.col(order).alias("o"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("p", "w"))
    words = words.select("o", "p", "w", F.lower(ascii_fold(F.col("w"))).alias("key"), turkish_lower(F.col("w")).alias("low"))
    acronym = F.col("w").rlike(r"^[A-Z0-9]*[A-Z][A-Z0-9]*$") & (F.length("w") >= 2)
    form = F.when(~acronym & ((F.col("key") != F.col("low")) | F.col("w").rlike(r"[^\x00-\x7F]")) & (F.length("key") >= 2), F.col("low"))
    grouped = words.groupBy("key").agg(F.bool_or(acronym).alias("bad"), F.min_by(form, F.when(form.isNotNull(), F.struct("o", "p"))).alias("form"))
    return grouped.where("not bad and form is not null").select("key", "form")


def respelled(texts: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``id, text`` with known words in their Turkish form; case of the first letter and marks stay."""
    pieces = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)).alias("p", "w"))
    joined = pieces.withColumn("key", F.lower(ascii_fold(F.col("w")))).join(lexicon, "key", "left")
    capital = F.substring("w", 1, 1) != F.lower(F.substring("w", 1, 1))
    form = F.when(capital, F.concat(F.upper(F.substring("form", 1, 1)), F.expr("substring(form, 2)"))).otherwise(F.col("form"))
    made = joined.select("id", F.struct("p", F.coalesce(form, "w").alias("w")).alias("x")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), "").alias("text"))
    return texts.select(F.col(id_col).alias("id")).join(made, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def fix_first_token(answer: Column, tag: Column, openings: dict[str, str]) -> Column:
    """Replace a leading pronoun by the tag's own opening word."""
    table = F.create_map(*[F.lit(x) for kv in openings.items() for x in kv]) if openings else F.create_map().cast("map<string,string>")
    own = F.element_at(table, tag)
    return F.when(own.isNotNull(), F.concat(own, F.regexp_replace(answer, r"(?i)^(ben|sen|o|bu|su)\b", ""))).otherwise(answer)


# --- intents, chunks, chats --------------------------------------------------------------------------


def build_intents(articles: DataFrame, title: str, extract: str, most: int = 3) -> DataFrame:
    """``tag, patterns, responses`` of articles with a usable title and at least two sentences."""
    tag = ascii_letters_only(F.lower(ascii_fold(F.trim(F.replace(F.col(title), F.lit("_"), F.lit(" "))))))
    lines = F.filter(F.transform(usable_sentences(F.col(extract)), strip_foreign_scripts), lambda s: (F.size(F.split(s, " ")) >= 3) & ~s.rlike(r"\(\s*d\.?\s*$|\(\s*$"))
    made = articles.where(F.length(extract) >= 150).select(tag.alias("tag"), F.slice(lines, 1, most).alias("responses"))
    made = made.where((F.length("tag") >= 3) & (F.size(F.split("tag", " ")) <= 6) & (F.size("responses") >= 2) & ~is_harmful(F.col("tag")))
    return made.select("tag", F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("tag")) for t in TEMPLATES]).alias("patterns"), "responses")


def generated_patterns(topic: Column, extras: list[str], k: int = 3) -> Column:
    """Templates of a topic and ``k`` of the further ones, chosen by its hash."""
    start = (djb2(topic) % len(extras)).cast("int")
    ring = F.array(*[F.replace(F.lit(t), F.lit("{}"), topic) for t in extras + extras])
    return F.array_distinct(F.concat(F.array(*[F.replace(F.lit(t), F.lit("{}"), topic) for t in TEMPLATES]), F.slice(ring, start + 1, F.lit(min(k, len(extras))))))


def seed_chunks(intents: DataFrame, least: int = 40) -> DataFrame:
    """Corpus chunks of intents whose joined responses are long enough."""
    joined = intents.select(slug(F.col("tag")).alias("id"), F.col("tag").alias("title"), F.array_join("responses", " ").alias("text"), F.array_join("patterns", " ").alias("patterns"), F.lit("intents-seed").alias("source"))
    return joined.where((F.length("text") >= least) & (F.col("id") != ""))


def build_chats(threads: DataFrame, order: str, most: int = 3) -> DataFrame:
    """``ord, query, answer`` of threads (``title, nsfw, comments, score, bodies``): clean lines, the first thread of a question."""
    ok = threads.where(passes_thread(F.col("nsfw"), F.col("comments"), F.col("score")))
    lines = F.filter(F.transform("bodies", lambda b: line_gate(b)["line"]), lambda x: x.isNotNull())
    made = ok.select(F.col(order).alias("ord"), line_gate(F.col("title"))["line"].alias("query"), F.slice(lines, 1, most).alias("answer"), "score").where("query is not null and size(answer) > 0")
    rn = F.row_number().over(Window.partitionBy(F.lower(ascii_fold(F.col("query")))).orderBy("ord"))
    return made.withColumn("rn", rn).where("rn = 1").drop("rn")


def forum_chats(topics: DataFrame, most: int = 3) -> DataFrame:
    """``topic_id, query, answer`` of forum topics (``topic_id, title, posts`` as HTML)."""
    texts = F.transform("posts", html_to_text)
    answers = F.filter(F.transform(F.slice(texts, F.lit(2), F.greatest(F.size("posts"), F.lit(1))), lambda b: line_gate(b)["line"]), lambda x: x.isNotNull())
    query = F.coalesce(line_gate(F.col("title"))["line"], line_gate(F.try_element_at(texts, F.lit(1)))["line"])
    return topics.select("topic_id", query.alias("query"), F.slice(answers, 1, most).alias("answer")).where("query is not null and size(answer) > 0")


def learned_ids(rows: DataFrame, title: str, text: str, existing: DataFrame | None = None) -> DataFrame:
    """Ids ``ogr_<slug>_<hash>``; another text with the same id gets ``_2``, ``_3``; known ids are skipped."""
    s = slug(F.col(title))
    base = F.concat_ws("_", F.lit("ogr"), F.when(s != "", s), F.substring(F.sha1(F.coalesce(F.col(text), F.lit(""))), 1, 8))
    each = rows.withColumn("__base", base).withColumn("__rn", F.dense_rank().over(Window.partitionBy("__base").orderBy(text)))
    if existing is not None:
        taken = existing.select(F.regexp_replace("id", r"_\d+$", "").alias("__root"), "id").groupBy("__root").agg(F.count(F.lit(1)).alias("__taken"))
        each = each.join(taken, each["__base"] == taken["__root"], "left").withColumn("__rn", F.col("__rn") + F.coalesce("__taken", F.lit(0))).drop("__root", "__taken")
    return each.withColumn("id", F.when(F.col("__rn") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.col("__rn").cast("string")))).drop("__base", "__rn")


def knowledge_map(patterns: DataFrame, hits: DataFrame, docs: DataFrame, width: int = 300, least: int = 20) -> DataFrame:
    """``q, ctx, title, text, score``: each pattern (``q, ctx``) with its best hit's (``q, doc, score``) text."""
    found = patterns.join(hits, "q").join(docs, "doc")
    text = cut_at_word(F.concat_ws(". ", "title", "text"), width)
    return found.select("q", clean_chars(F.col("ctx")).alias("ctx"), "title", text.alias("text"), "score").where((F.length("ctx") >= 6) & (F.length("text") >= least))


def extract_count(message: Column) -> Column:
    """A number from 1 to 10 that a message asks for, as digits or as a word."""
    t = F.lower(ascii_fold(message))
    digits = F.regexp_extract(t, r"\b(\d{1,2})\b", 1).cast("int")
    word = F.try_element_at(F.filter(F.transform(ascii_tokens(message), lambda w: F.element_at(F.create_map(*[F.lit(x) for kv in COUNT_WORDS.items() for x in kv]), w)), lambda n: n.isNotNull()), F.lit(1))
    return F.when(digits.between(1, 10), digits).when(t.rlike(r"\bbir ?kac\b"), 3).otherwise(word)


def counted_list(items: Column, count: Column) -> Column:
    """``1. a. 2. b.`` of the first distinct items; null with fewer than two."""
    titles = F.array_distinct(F.filter(F.transform(items, lambda x: F.rtrim(F.regexp_replace(F.substring(x, 1, 140), r"[!.,; ]+$", ""))), lambda x: x != ""))
    chosen = F.slice(titles, F.lit(1), count)
    return F.when(F.size(titles) >= 2, F.array_join(F.transform(chosen, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("."))), " "))


def select_response(candidates: DataFrame, q: str, words: str, response: str, tokens: str) -> DataFrame:
    """Per query the response with most shared words, half a point for each found inside it; ties by hash."""
    asked = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*[F.lit(x) for x in STOP_EVAL]), w))
    flat = F.lower(ascii_fold(F.col(response)))
    score = F.size(F.array_intersect(asked, tokens)) + 0.5 * F.size(F.filter(F.array_distinct(asked), lambda w: F.contains(flat, w)))
    rated = candidates.select(F.col(q).alias("q"), F.col(response).alias("r"), score.alias("s"))
    return rated.groupBy("q").agg(F.max_by("r", F.struct("s", F.md5("r"))).alias("response"), F.max("s").alias("score")).withColumnRenamed("q", q)


class _Inside(dict):
    """Tokens to the places of the words that they contain; bounded, filled on demand."""

    def __init__(self, places: dict[str, int]):
        super().__init__()
        self.places, self.longest = places, max(map(len, places), default=0)

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= 100_000:
            self.clear()
        ends = range(3, self.longest + 1)
        self[token] = found = tuple({self.places[w] for i in range(len(token) - 2) for n in ends if i + n <= len(token) and (w := token[i : i + n]) in self.places})
        return found


def matched_responses(queries: DataFrame, q: str, text: str, responses: DataFrame, response: str, by: str) -> DataFrame:
    """``select_response`` of all queries with all responses of the same ``by``; no pair becomes a row.

    A query's words are runs of letters and digits, so what a response contains of them is inside
    its own tokens. These are looked up once for each response, for all queries of a block.
    """
    asked = F.filter(ascii_tokens(F.col(text)), lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*[F.lit(x) for x in STOP_EVAL]), w))
    wanted = queries.where(F.col(by).isNotNull()).select(F.col(q).alias("q"), F.col(by).alias("by"), F.array_distinct(asked).alias("words"))
    rows = responses.where(F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col(response).alias("r"), F.md5(response).alias("h"), F.array_distinct(ascii_tokens(F.col(response))).alias("toks"))
    q_type, r_type = wanted.schema["q"].dataType, rows.schema["r"].dataType
    schema = f"q {q_type.simpleString()}, s double, h string, r {r_type.simpleString()}"
    parts = []
    for block in query_blocks(wanted, "q"):
        found = block.collect()
        places = {w: k for k, w in enumerate(sorted({w for x in found for w in x["words"]}))}
        groups = {}
        for x in found:
            groups.setdefault(x["by"], []).append((x["q"], [places[w] for w in x["words"]]))
        held = rows.sparkSession.sparkContext.broadcast((places, groups))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            places, groups = held.value
            inside, best, step = _Inside(places), {}, max(1, 4_000_000 // max(1, len(places)))
            tables = {}
            for kind, xs in groups.items():
                tables[kind] = table = np.zeros((len(places), len(xs)), np.float32)
                for j, (_, own) in enumerate(xs):
                    table[own, j] = 1
            for batch in batches:
                kinds, texts, hashes, toks = (c.to_pylist() for c in batch.columns)
                order = sorted(range(len(kinds)), key=lambda i: hashes[i] or "", reverse=True)  # of equal scores the first is wanted
                for kind, table in tables.items():
                    own = [i for i in order if kinds[i] == kind]
                    for lo in range(0, len(own), step):
                        part = own[lo : lo + step]
                        weights = np.zeros((len(part), len(places)), np.float32)
                        for k, i in enumerate(part):
                            weights[k, list(set().union(*[inside[t] for t in toks[i]]))] = 0.5
                            weights[k, [places[t] for t in toks[i] if t in places]] = 1.5
                        scores = weights @ table
                        first = scores.argmax(axis=0)
                        for j, k in enumerate(first.tolist()):
                            made = (float(scores[k, j]), hashes[part[k]] or "")
                            if (kind, j) not in best or made > best[kind, j][0]:
                                best[kind, j] = (made, texts[part[k]])
            out = [(groups[kind][j][0], s, h, r) for (kind, j), ((s, h), r) in best.items()]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (to_arrow_type(q_type), pa.float64(), pa.string(), to_arrow_type(r_type)))], ["q", "s", "h", "r"])

        parts.append(rows.mapInArrow(run, schema))
    return union_all(parts).groupBy("q").agg(F.max_by("r", F.struct("s", "h")).alias("response"), F.max("s").alias("score")).withColumnRenamed("q", q)


def negation(message: Column, negative: list[str] = NEGATIVE, endings: list[str] = NEGATIVE_ENDINGS) -> Column:
    """``struct(negated, topic)``: whether a message is negative, and its other words of four letters."""
    words = F.filter(F.split(F.lower(ascii_fold(message)), r"\s+"), lambda w: F.length(w) >= 3)
    ends = "(" + "|".join(endings) + ")$"
    bad = lambda w: F.array_contains(F.array(*[F.lit(x) for x in negative]), w) | ((F.length(w) >= 5) & w.rlike(ends))
    return F.struct(F.exists(words, bad).alias("negated"), F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~bad(w))).alias("topic"))


def dialogue_memory(turns: DataFrame, conv: str, turn: str, tag: str) -> DataFrame:
    """Each turn with the last tag that an earlier turn of its conversation had."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("last_tag", F.last(tag, ignorenulls=True).over(w))


# --- paraphrases and generated text ----------------------------------------------------------------


class Paraphraser:
    """Deterministic variants of a text: openers, swapped words, closers; the first word stays."""

    def __init__(self, swaps: dict[str, list[str]], closers: list[str], inserts: list[str], attempts: int = 6):
        self.swaps, self.closers, self.inserts, self.attempts = swaps, closers, inserts, attempts

    def variants(self, text: str, k: int) -> list[str]:
        seen, out = {text}, []
        for salt in range(self.attempts * max(1, k)):
            if len(out) >= k:
                break
            rng = random.Random(hashlib.md5(f"{salt}:{text}".encode()).digest())
            words = text.split()
            for i in range(1, len(words)):
                base = words[i].rstrip(".,!?;:")
                if base in self.swaps and rng.random() < 0.5:
                    words[i] = rng.choice(self.swaps[base]) + words[i][len(base) :]
            if len(text) >= 60 and self.inserts and rng.random() < 0.35:
                at = rng.randint(len(words) // 3, max(len(words) // 3, len(words) * 5 // 6))
                words.insert(max(1, at), rng.choice(self.inserts))
            if self.closers and rng.random() < 0.5:
                words.append(rng.choice(self.closers))
            made = " ".join(words)
            if made not in seen:
                seen.add(made)
                out.append(made)
        return out


def paraphrased(rows: DataFrame, text: str, paraphraser: Paraphraser, k: int) -> DataFrame:
    """Every row with up to ``k`` further rows whose text is a variant; ``variant`` counts from 0."""

    @F.pandas_udf("array<string>")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: paraphraser.variants(t, k) if t else [])

    many = F.concat(F.array(F.col(text)), F.coalesce(make(F.col(text)), F.array().cast("array<string>")))
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(many).alias("variant", text))


def sample_next(logits: np.ndarray, rng: np.random.Generator, temperature: float = 0.7, top_k: int = 10, banned: frozenset[int] = frozenset(), seen: list[int] | None = None, penalty: float = 0.5, bias: np.ndarray | None = None) -> int:
    """One token: repetition penalty and bias on the logits, temperature, the best ``top_k``."""
    z = logits.astype(float).copy()
    if seen:
        z[np.unique(seen)] -= penalty
    if bias is not None:
        z += bias
    z[list(banned)] = -np.inf
    top = np.argsort(-z, kind="stable")[:top_k]
    top = top[np.isfinite(z[top])]
    if not len(top):
        return -1
    p = np.exp((z[top] - z[top].max()) / max(temperature, 1e-6))
    return int(rng.choice(top, p=p / p.sum()))


def markov_text(edges: DataFrame, starts: DataFrame, id_col: str, start: str, length: int = 12, temperature: float = 1.15, top_k: int = 6) -> DataFrame:
    """Texts that walk a pruned transition table from each start word, by a hash of the row's id and the step.

    Of every head the ``top_k`` best edges (``head, next, n``) take part. Each step is a join of
    the walkers with the table, so the table may have any size.
    """
    rn = F.row_number().over(Window.partitionBy("head").orderBy(F.col("n").desc(), "next"))
    best = edges.withColumn("rn", rn).where(F.col("rn") <= top_k).withColumn("w", F.pow(F.col("n").cast("double"), F.lit(1 / temperature)))
    share = Window.partitionBy("head").orderBy("next")
    upto, total = F.sum("w").over(share.rowsBetween(Window.unboundedPreceding, 0)), F.sum("w").over(Window.partitionBy("head"))
    table = best.select("head", F.struct((upto / total).alias("upto"), "next").alias("x")).groupBy("head").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    table = materialise(table, "markov-table")
    walk = starts.select(F.col(id_col).alias("id"), F.col(start).alias("last"), F.array(start).alias("words"))
    for step in range(1, length):
        chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(step)))), 1, 8), 16, 10).cast("double") / float(2**32)
        joined = walk.withColumn("r", chance).join(table, F.col("last") == F.col("head"), "left")
        chosen = F.coalesce(F.get(F.filter("xs", lambda x: x["upto"] > F.col("r")), F.lit(0)), F.get("xs", F.size("xs") - 1))["next"]
        moved = joined.withColumn("to", F.when(F.col("xs").isNotNull(), chosen))
        walk = moved.select("id", F.col("to").alias("last"), F.when(F.col("to").isNotNull(), F.concat("words", F.array("to"))).otherwise(F.col("words")).alias("words"))
        walk = materialise(walk, "markov-walk") if step % 4 == 0 else walk
    return walk.select("id", F.array_join("words", " ").alias("text"))


def scored(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[float]]], name: str = "score") -> DataFrame:
    """Rows with a model's score; ``load`` makes the scoring function once in each worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for texts in batches:
            yield pd.Series(score(texts.fillna("").tolist()), index=texts.index, dtype=float)

    return rows.withColumn(name, run(F.col(text)))


def trained_classifier(rows: DataFrame, tokens: str, label: str, features: int = 1 << 14):
    """A logistic-regression pipeline on hashed token counts; ``transform`` adds the prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer

    stages = [StringIndexer(inputCol=label, outputCol="__label", handleInvalid="keep"), HashingTF(inputCol=tokens, outputCol="__features", numFeatures=features), LogisticRegression(featuresCol="__features", labelCol="__label", regParam=1e-3, maxIter=50)]
    return Pipeline(stages=stages).fit(rows)
