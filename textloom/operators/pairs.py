"""Pair builders: conversations, instructions, verses, prose and intents to (context, response)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.gates import BAD_SOURCES, is_exam_residue, is_foreign
from textloom.functions.text import clean_chars, clean_response, cut_at_word, prose_sentences, verses
from textloom.functions.tokens import djb2

#: Names that sources give to the two sides of a conversation (fixed values).
USER_ROLES = ("user", "human", "soru", "query")
ANSWER_ROLES = ("assistant", "gpt", "ai", "cevap")


def chat_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each answer with the question right before it: ``conv, turn, ctx, resp``.

    Blank turns and other roles are passed over; of several questions the last counts; an answer
    without one, or a second answer, gives nothing.
    """
    kind = F.when(F.lower(role).isin(*USER_ROLES), "q").when(F.lower(role).isin(*ANSWER_ROLES), "a")
    valid = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), kind.alias("kind"), F.trim(F.coalesce(text, F.lit(""))).alias("text")).where("kind is not null and text <> ''")
    w = Window.partitionBy("conv").orderBy("turn")
    both = valid.select("conv", "turn", "kind", F.col("text").alias("resp"), F.lag("kind").over(w).alias("before"), F.lag("text").over(w).alias("ctx"))
    return both.where("kind = 'a' and before = 'q'").select("conv", "turn", "ctx", "resp")


def gated_pairs(pairs: DataFrame, source: str | None = None, own: list[str] | None = None, other: list[str] | None = None, check_language: bool = True) -> DataFrame:
    """Pairs without banned sources, exam residue and, if asked, foreign languages."""
    words = {k: v for k, v in (("own", own), ("other", other)) if v is not None}
    out = pairs.where(~F.coalesce(F.col(source), F.lit("")).isin(*BAD_SOURCES)) if source else pairs
    if check_language:
        out = out.where(~is_foreign(F.col("ctx"), **words) & ~is_foreign(F.col("resp"), **words))
    return out.where(~is_exam_residue(F.col("ctx")) & ~is_exam_residue(F.col("resp")))


def instruction_pairs(rows: DataFrame, instruction: str = "instruction", given: str = "input", output: str = "output") -> DataFrame:
    """``instruction | input`` (or the instruction alone) and the output."""
    blank = F.trim(F.coalesce(given, F.lit(""))) == ""
    ctx = F.when(blank, F.trim(instruction)).otherwise(F.concat_ws(" | ", F.trim(instruction), F.trim(given)))
    return rows.select(ctx.alias("ctx"), F.trim(output).alias("resp")).where("ctx <> '' and resp <> ''")


def thinking_pairs(rows: DataFrame, question: str, thought: str, answer: str, prefix: str = "dusun: ") -> DataFrame:
    """The plain pair and, where there is a thought, one whose answer begins with it."""
    plain = F.struct(F.trim(question).alias("ctx"), F.trim(answer).alias("resp"))
    with_thought = F.struct(F.concat(F.lit(prefix), F.trim(question)).alias("ctx"), F.concat_ws(" ", F.trim(thought), F.trim(answer)).alias("resp"))
    made = F.when(F.trim(F.coalesce(thought, F.lit(""))) != "", F.array(plain, with_thought)).otherwise(F.array(plain))
    return rows.select(F.explode(made).alias("p")).select("p.ctx", "p.resp").where("ctx <> '' and resp <> ''")


def question_pairs(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """One gated pair for each row."""
    return gated_pairs(rows.select(F.trim(question).alias("ctx"), F.trim(answer).alias("resp")).where("ctx <> '' and resp <> ''"))


def message_text(message: Column) -> Column:
    """A message's text, whichever of the usual fields holds it (a map of strings)."""
    return F.coalesce(*[F.nullif(F.trim(F.element_at(message, k)), F.lit("")) for k in ("content", "text", "value")])


#: Sources whose records are conversations (fixed values).
CONVERSATION_SOURCES = ("SoAp9035/everyday-conversations-tur", "3nesdeniz/turkish-daily-dialogues-5k", "kilicai/turkish-sft-multi-turn-dialogue-10k", "seed")


def conversation_pairs(chats: DataFrame, sources: tuple[str, ...] = CONVERSATION_SOURCES, ctx_max: int = 64, resp_max: int = 204, cap: int | None = 20_000, seed: int = 11) -> DataFrame:
    """``ctx, resp`` of chat records (``query, answer, source``) from allowed sources, each pair once.

    Both sides are cleaned and have six characters; the order is by hash, and ``cap`` bounds the
    training set (None: all).
    """
    from textloom.operators.sampling import shuffle_key

    each = chats.where(F.col("source").isin(*sources)).select(clean_chars(F.col("query"), ctx_max).alias("ctx"), F.explode("answer").alias("a"))
    made = each.select("ctx", clean_response(F.col("a"), resp_max).alias("resp")).where((F.length("ctx") >= 6) & (F.length("resp") >= 6)).distinct()
    return made.orderBy(shuffle_key("ctx", "resp", seed=seed), "ctx", "resp").limit(cap) if cap is not None else made


def without_overlap(knowledge: DataFrame, conversation: DataFrame, ctx: str = "ctx") -> DataFrame:
    """Knowledge pairs whose context no conversation pair has."""
    return knowledge.join(conversation.select(ctx).distinct(), ctx, "left_anti")


#: Converters of sources to pairs (fixed names); a converter takes the source's rows.
CONVERTERS = {
    "tascib/turkish-instruction": lambda rows: instruction_pairs(rows),
    "erythropygia/ThinkingData-200K-Turkish": lambda rows: thinking_pairs(rows, "question", "reasoning", "answer"),
    "kilicai/turkish-sft-multi-turn-dialogue-10k": lambda rows: gated_pairs(chat_pairs(rows).select("ctx", "resp")),
    "3nesdeniz/turkish-daily-dialogues-5k": lambda rows: gated_pairs(chat_pairs(rows, text="content").select("ctx", "resp")),
    "SoAp9035/everyday-conversations-tur": lambda rows: gated_pairs(chat_pairs(rows, text="value").select("ctx", "resp")),
    "Renicames/turkish-law-chatbot": lambda rows: question_pairs(rows, "question", "answer"),
}


def source_pairs(rows: DataFrame, source: str, max_pairs: int, thoughts: bool = False, seed: int = 7) -> DataFrame:
    """Pairs of a source by its converter, shuffled by hash: twice the wanted number (three times with thoughts) and 64, to make up for later losses."""
    from textloom.operators.sampling import shuffle_key

    if source not in CONVERTERS:
        raise KeyError(f"no converter for {source}")
    budget = max_pairs * (3 if thoughts else 2) + 64
    return CONVERTERS[source](rows).limit(budget).orderBy(shuffle_key("ctx", "resp", seed=seed), "ctx", "resp")


def verse_pairs(works: DataFrame, id_col: str, text_col: str, ctx_max: int = 300, resp_max: int = 300) -> DataFrame:
    """Each verse from the third on, with the two before it."""
    lines = works.select(F.col(id_col).alias("id"), F.posexplode(verses(F.col(text_col))).alias("at", "line"))
    w = Window.partitionBy("id").orderBy("at")
    near = lines.select("id", "at", F.concat_ws(" ", F.lag("line", 2).over(w), F.lag("line").over(w)).alias("ctx"), F.col("line").alias("resp")).where("at >= 2")
    cut = near.select("id", "at", cut_at_word(F.col("ctx"), ctx_max).alias("ctx"), cut_at_word(F.col("resp"), resp_max).alias("resp"))
    return cut.where((F.length("ctx") >= 20) & (F.length("resp") >= 10))


def prose_pairs(paragraphs: DataFrame, id_col: str, text_col: str, ctx_max: int = 300, resp_max: int = 300, least: int = 7) -> DataFrame:
    """First and second half of paragraphs of at least ``least`` sentences."""
    s = F.col("s")
    half = F.floor(F.size(s) / 2).cast("int")
    halves = paragraphs.select(F.col(id_col).alias("id"), prose_sentences(F.col(text_col)).alias("s")).where(F.size("s") >= least)
    made = halves.select("id", F.array_join(F.slice(s, F.lit(1), half), " ").alias("ctx"), F.array_join(F.slice(s, half + 1, F.size(s)), " ").alias("resp"))
    cut = made.select("id", cut_at_word(clean_chars(F.col("ctx")), ctx_max).alias("ctx"), cut_at_word(clean_chars(F.col("resp")), resp_max).alias("resp"))
    return cut.where((F.length("ctx") >= 20) & (F.length("resp") >= 20))


def is_knowledge(kind: Column, patterns: Column) -> Column:
    """Explicit kind, else more than six patterns."""
    return F.coalesce(kind == "bilgi", F.size(patterns) > 6)


def intent_pairs(intents: DataFrame, resp_max: int = 204, ctx_max: int = 48) -> DataFrame:
    """Pairs of an intents table (``ord, tag, patterns, responses, kind``): ``ctx, resp, ord``.

    A context belongs to one intent: knowledge before chat, then the earlier. Six-pattern
    intents that are not chat pair every context with every response, others with one by hash.
    """
    long = lambda xs: F.filter(xs, lambda x: F.length(x) >= 6)
    ready = intents.select(
        "ord",
        F.array_distinct(long(F.transform("responses", lambda r: clean_response(r, resp_max)))).alias("resps"),
        F.coalesce(F.nullif(long(F.transform("patterns", lambda p: clean_chars(p, ctx_max))), F.array().cast("array<string>")), F.array(clean_chars(F.replace("tag", F.lit("_"), F.lit(" ")), ctx_max))).alias("ctxs"),
        ((F.size("patterns") == 6) & (F.coalesce("kind", F.lit("")) != "sohbet")).alias("known"),
    ).where(F.size("resps") > 0)
    each = ready.select("ord", "resps", "known", F.posexplode("ctxs").alias("at", "ctx")).where("ctx <> ''")
    w = Window.partitionBy("ctx").orderBy(F.col("known").desc(), "ord", "at")
    one = each.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    picked = F.element_at("resps", (djb2(F.col("ctx")) % F.size("resps") + 1).cast("int"))
    return one.select("ord", "ctx", F.explode(F.when(F.col("known"), F.col("resps")).otherwise(F.array(picked))).alias("resp"))


def encode_pair(ctx: Column, resp: Column, bos: int = 1, eos: int = 2, sep: int = 3) -> tuple[Column, Column]:
    """Ids ``bos ctx sep resp eos`` and the mask over separator to last response id."""
    one = lambda k: F.array(F.lit(k))
    ids = F.concat(one(bos), ctx, one(sep), resp, one(eos))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(ctx) + 1), F.array_repeat(F.lit(1), F.size(resp) + 1), one(0))
    return ids, mask


def padded_example(ctx: Column, resp: Column, knowledge: Column | None, length: int, pad: int = 0) -> Column:
    """An example of fixed length; knowledge takes what context and markers leave, then all is cut and padded."""
    middle = F.array().cast("array<int>") if knowledge is None else F.slice(knowledge, F.lit(1), F.greatest(F.lit(8), F.lit(length) - F.size(ctx) - 8))
    ids, _ = encode_pair(F.concat(ctx, middle), resp)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
