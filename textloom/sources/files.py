"""Scans and sinks of line-oriented and nested files, with fixed schemas and a reject table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "id string, title string, text string, patterns string, source string, added_at timestamp"
CHAT = "query string, soru string, source string, subreddit string, topic_id bigint, score int"
INTENTS = "intents array<struct<tag:string, patterns:array<string>, responses:array<string>, tur:string>>"
#: Header names of a spreadsheet's text column (fixed values).
TEXT_HEADERS = ("metin", "soru", "mesaj", "girdi", "cumle", "yazi", "text", "message", "input", "icerik")


def _with_rejects(spark: SparkSession, paths: str | list[str], schema: str, sanity: str) -> tuple[DataFrame, DataFrame]:
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    good = F.col("_corrupt_record").isNull() & F.expr(sanity)
    return rows.where(good).drop("_corrupt_record"), rows.where(~F.coalesce(good, F.lit(False))).select("file", "_corrupt_record")


def scan_corpus(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Corpus chunks of JSON lines, and the lines that are not chunks."""
    return _with_rejects(spark, paths, CHUNK, "id is not null")


def answers(raw: Column) -> Column:
    """A chat record's answers, given as a list or as one string, under either of two names."""
    listed = F.from_json(raw, "answer array<string>, answers array<string>")
    single = lambda k: F.get_json_object(raw, f"$.{k}")
    one = F.coalesce(single("answer"), single("answers"))
    return F.coalesce(listed["answer"], listed["answers"], F.when(one.isNotNull(), F.array(one)))


def scan_chats(spark: SparkSession, paths: str | list[str], defaults: bool = False) -> DataFrame:
    """Chat records with a question: ``ord, query, answer, source, subreddit, topic_id, score``.

    Rows come in the order of the paths given, then of lines; lines that are no JSON object go,
    as do paths where there is nothing.
    With ``defaults`` an answer is required and missing source, subreddit and score are filled.
    """
    listed = existing_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    if not listed:
        empty = "ord struct<path_rank:int, file:string, line:bigint>, query string, answer array<string>, source string, subreddit string, topic_id bigint, score int"
        return spark.createDataFrame([], empty)
    parts = [spark.read.text(p).select("value", F.lit(k).alias("path_rank"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")) for k, p in enumerate(listed)]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    j = F.from_json("value", CHAT)
    rows = lines.select("path_rank", "file", "line", j.alias("j"), answers(F.col("value")).alias("answer"))
    rows = rows.select("path_rank", "file", "line", F.coalesce("j.query", "j.soru").alias("query"), "answer", "j.source", "j.subreddit", "j.topic_id", "j.score").where("query <> ''")
    if defaults:
        rows = rows.where(F.size("answer") > 0).withColumns({"source": F.coalesce("source", F.lit("seed")), "subreddit": F.coalesce("subreddit", F.lit("seed")), "score": F.coalesce("score", F.lit(0))})
    return rows.select(F.struct("path_rank", "file", "line").alias("ord"), "query", "answer", "source", "subreddit", "topic_id", "score")


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or globs) that name something, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).globStatus(at):
            out.append(path)
    return out


def discover(spark: SparkSession, folder: str, pattern: str = "chatgrow*.jsonl") -> list[str]:
    """Files of a folder that match a glob, sorted by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    return sorted(s.getPath().toString() for s in at.getFileSystem(conf).globStatus(at) or [])


def scan_intents(spark: SparkSession, path: str) -> DataFrame:
    """The nested intents document as ``ord, tag, patterns, responses, kind``."""
    doc = spark.read.schema(INTENTS).option("multiLine", True).json(path)
    each = doc.select(F.posexplode("intents").alias("ord", "i"))
    return each.select("ord", "i.tag", F.coalesce("i.patterns", F.array().cast("array<string>")).alias("patterns"), F.coalesce("i.responses", F.array().cast("array<string>")).alias("responses"), F.col("i.tur").alias("kind"))


def intent_violations(intents: DataFrame) -> DataFrame:
    """Counts of schema rules that an intents table breaks."""
    n = lambda c, name: F.count_if(c).alias(name)
    return intents.agg(
        n(F.length("tag") < 2, "short_tag"), (F.count("tag") - F.count_distinct("tag")).alias("repeated_tag"), n(F.col("tag").rlike(r"[\p{L}&&[^\x00-\x7F]]"), "non_latin_tag"),
        n(F.size("patterns") == 0, "no_patterns"), n(F.size("responses") == 0, "no_responses"), n(F.exists("responses", lambda r: F.length(r) < 2), "short_response"), n((F.size("patterns") < 6), "few_patterns"),
    )


def new_shards(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """Shards of a listing (``shard``) that no earlier run has taken."""
    return listing.join(processed.select("shard").distinct(), "shard", "left_anti")


def read_texts(spark: SparkSession, paths: list[str], column: str = "text") -> DataFrame:
    """One column of Parquet shards; the scan reads no other."""
    return spark.read.parquet(*paths).select(column)


def load_prompts(spark: SparkSession, path: str, items: str = "sorular", declared: str = "adet") -> DataFrame:
    """A prompt list whose declared count must be its length."""
    row = spark.read.option("multiLine", True).schema(f"`{declared}` int, `{items}` array<string>").json(path).first()
    if row is None or row[items] is None or row[declared] != len(row[items]):
        raise ValueError(f"{path} declares {row and row[declared]} prompts but has {len(row[items] or []) if row else 0}")
    return spark.createDataFrame(list(enumerate(row[items])), "ord int, prompt string")


def scrape_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Numbers of the lines that match; group k of the pattern becomes the k-th column."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).cast("double").alias(n) for k, n in enumerate(names)])


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """``ord, text`` of a workbook's text column: a known header, else the first column."""
    try:
        import openpyxl
    except ImportError as missing:
        raise RuntimeError("reading workbooks needs openpyxl") from missing
    sheet = openpyxl.load_workbook(path, read_only=True).active
    rows = list(sheet.iter_rows(values_only=True))
    header = [str(c or "").strip().lower() for c in rows[0]] if rows else []
    at = next((k for k, h in enumerate(header) if h in TEXT_HEADERS), None)
    body = rows[1:] if at is not None else rows
    return spark.createDataFrame([(k, str(r[at or 0] or "")) for k, r in enumerate(body)], "ord int, text string")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def glob_paths(names: list[str], pattern: str = r"chatgrow.*\.jsonl$") -> list[str]:
    """File names that match, in order."""
    return sorted(n for n in names if re.search(pattern, n))
