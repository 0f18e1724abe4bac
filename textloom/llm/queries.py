"""The queries that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.byte_bpe import encode_texts, read_ranks
from textloom.llm.exact_dedup import exact_groups
from textloom.llm.order_minhash import near_duplicates
from textloom.llm.ordinal_quality import grade_documents, train_quality
from textloom.llm.pii_surrogates import replace_pii
from textloom.llm.template_decontam import contaminated
from textloom.llm.token_transducer import count_tokens
from textloom.llm.toxicity_chain import score_toxicity, train_toxicity
from textloom.llm.url_trees import Rule, judge_urls, rule_labels, train_urls
from textloom.llm.warc_index import archive_and_read

#: Ratings of the labels table as grades: 0 poor, 1 usable but toxic, 2 good.
GRADE, GRADES = "case when quality = 0 then 0 when toxic = 1 then 1 else 2 end", 3
#: Session setting that holds the key of the surrogates, and the key without it (tests).
SECRET_SETTING, SECRET = "spark.textloom.pii.secret", "rotate-me"
URL_RULES = [Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_model(spark: SparkSession, sf_dir: str):
    """The ordinal model of the documents and labels tables."""
    return train_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), GRADE, GRADES)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents"), spark.conf.get(SECRET_SETTING, SECRET))


def op2_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, train_urls(rule_labels(pages, URL_RULES)))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op8_token_transducer(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), read_ranks(path or public_tokenizers.path("byte_bpe_50k.json")))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_texts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False, forget=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_surrogates, op2_quality_ordinal, op3_template_decontam, op4_exact_dedup, op5_order_minhash, op6_url_trees, op7_toxicity_chain, op8_token_transducer, op9_warc_index, op10_byte_bpe, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    # base32 of the SHA-1: each five hex digits are twenty bits, four letters of five bits
    "op9_warc_index": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
        SELECT page_id, n::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
        FROM p""",
}
