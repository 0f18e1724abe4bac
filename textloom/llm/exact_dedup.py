"""Exact deduplication over a log-structured merge index of text digests.

Every task is a memtable: it flushes its (digest, id) rows as one sorted run with a Bloom
filter per row group (Parquet's own, for lookups of single digests). Compaction merges the runs
and keeps, for each digest, the smallest identifier and the number of rows. All runs of a flush
are merged at once; levels come from further flushes, ``fanout`` of which make a level.

A digest that the compacted level has once is settled. The others go into a filter of fixed
size, and only documents that it lets by are shuffled with their text to meet the level. A
digest held by several rows is only a hit: the whole texts are compared byte by byte with the
text of the row that would stay, and rows that merely share a digest are grouped again by text.

Only DataFrame functions are used. A digest's rows meet only in aggregates with a partial
step and in equi-joins that adaptive execution can split, so one text may make up any share
of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bit_filter import bit_filter, may_contain, surely_absent
from textloom.storage import materialise, scratch_path

#: Parquet writer options: a Bloom filter over the digests of each row group, as large as needed.
RUN_FILTERS = {
    "parquet.bloom.filter.enabled#digest": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": "1048576",
}


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column, digest_bytes: int = 32) -> Column:
    """SHA-256 of the UTF-8 bytes; a shorter prefix only serves to test collisions."""
    full = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))
    return full if digest_bytes >= 32 else F.substring(full, 1, digest_bytes)


class DigestIndex:
    """Sorted digest runs in levels; ``fanout`` flushes make a level that compaction merges."""

    def __init__(self, spark: SparkSession, fanout: int = 8, id_type: str = "bigint"):
        self.spark, self.fanout, self.id_type = spark, fanout, id_type
        self.fresh: list[str] = []
        self.merged: str | None = None

    def flush(self, rows: DataFrame) -> None:
        """Write (digest, id) rows as sorted runs, one for each task's memtable."""
        path = scratch_path(self.spark, "digest-run")
        rows.select("digest", F.col("id").cast(self.id_type).alias("id")).sortWithinPartitions("digest", "id").write.options(**RUN_FILTERS).parquet(path)
        self.fresh.append(path)
        if len(self.fresh) >= self.fanout:
            self.compact()

    def rows(self) -> DataFrame:
        """All (digest, id) rows that were flushed since the last compaction; maybe none."""
        schema = f"digest binary, id {self.id_type}"
        return self.spark.read.schema(schema).parquet(*self.fresh) if self.fresh else self.spark.createDataFrame([], schema)

    def level(self) -> DataFrame:
        """The compacted level as it is: digest, smallest id, number of rows; maybe empty."""
        schema = f"digest binary, keep_id {self.id_type}, n bigint"
        return self.spark.read.schema(schema).parquet(self.merged) if self.merged else self.spark.createDataFrame([], schema)

    def compact(self) -> DataFrame:
        """Merge the fresh runs into the level; without fresh runs the level stays as it is."""
        if not self.fresh:
            return self.level()
        both = self.rows().groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        if self.merged:
            both = both.unionByName(self.level()).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        path = scratch_path(self.spark, "digest-level")
        both.sortWithinPartitions("digest").write.options(**RUN_FILTERS).parquet(path)
        self.fresh, self.merged = [], path
        return self.level()

    def probe(self, digests: list[bytes]) -> DataFrame:
        """Index entries of a short list of digests; filters and footers skip other row groups."""
        if len(digests) > 1000:
            raise ValueError("probe() is for short lists; join with compact() instead")
        return self.compact().where(F.col("digest").isin([bytearray(d) for d in digests]))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, carry: bool = False, batches: int = 1, fanout: int = 8) -> DataFrame:
    """One row per input row: its group of equal texts and whether it stays.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``; with ``carry`` instead the
    input's own columns, kept rows only. Null texts equal empty ones. A null id loses to any
    other; of rows that repeat both id and text, one stays. An empty input gives no rows;
    further columns, whatever their names, are ignored or carried. ``batches`` flushes the
    documents in so many parts by a hash of their id, so that levels grow; the result is the same.
    """
    spark = docs.sparkSession
    body = normalised(docs[text_col])
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]) if carry else F.struct(docs[id_col].alias("c0"))
    keyed = docs.select(docs[id_col].alias("id"), body.alias("body"), row.alias("row")).withColumn("digest", text_digest(F.col("body"), digest_bytes))

    index = DigestIndex(spark, fanout, docs.schema[id_col].dataType.simpleString())
    for part in range(batches):
        index.flush(keyed.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == part) if batches > 1 else keyed)
    level = index.compact()
    repeated = level.where("n > 1")
    known, hashed = bit_filter(repeated.select(F.xxhash64("digest").alias("h")), write=carry), F.xxhash64("digest")

    looked_up = materialise(may_contain(keyed, hashed, known).join(repeated, "digest", "left"), "digest-hits")
    hits = looked_up.where("n is not null")
    stays = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("keep_body"))
    stays = materialise(stays, "digest-stays")  # as a scan, so that a hot digest's rows can be split in the join
    same = F.col("body") == F.col("keep_body")
    checked = materialise(
        hits.join(stays, "digest").select("digest", "id", "keep_id", "n", same.alias("same"), F.when(~same, F.col("body")).alias("odd_body"), *(["row"] if carry else [])),
        "digest-checked",
    )
    true_groups = _regrouped(checked) if not checked.where("not same").isEmpty() else checked.withColumn("part", F.lit(None).cast("string"))
    heads = true_groups.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "part", "id", "keep_id", "n")
    if carry:
        singles = surely_absent(keyed, hashed, known).select("row").unionByName(looked_up.where("n is null").select("row"))
        out = singles.unionByName(heads.agg(F.first("row").alias("row")).select("row"))
        return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    # rows that repeat id and text are counted and dealt out again: the first stays
    heads = heads.agg(F.count(F.lit(1)).alias("many")).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).withColumn("kept", F.col("at") == 1)
    rest = true_groups.where(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    singles = level.where("n = 1").select("digest", F.col("keep_id").alias("id"), "keep_id", "n", F.lit(True).alias("kept"))
    columns = ["digest", "id", "keep_id", "n", "kept"]
    every = singles.unionByName(heads.select(columns)).unionByName(rest.select(columns))
    return every.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _regrouped(checked: DataFrame) -> DataFrame:
    """Rows whose digest collides with another text, grouped by the text itself."""
    odd = checked.where("not same")
    again = odd.groupBy("digest", "odd_body").agg(F.min("id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("n_odd"))
    good = checked.where("same").join(fewer, "digest", "left").withColumn("n", F.col("n") - F.coalesce("n_odd", F.lit(0))).drop("n_odd")
    bad = odd.join(again, ["digest", "odd_body"]).withColumn("keep_id", F.col("own_keep")).withColumn("n", F.col("own_n")).drop("own_keep", "own_n")
    columns = checked.columns
    return good.select(columns).unionByName(bad.select(columns)).withColumn("part", F.col("odd_body"))
