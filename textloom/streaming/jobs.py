"""Structured Streaming jobs: incremental ingest, idempotent append, rate limiting."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.functions.text import paragraphs


def chunks(texts: DataFrame, text: str) -> DataFrame:
    """Corpus chunks of texts: the paragraph's short digest as id, its beginning as title."""
    each = texts.select(F.explode(paragraphs(F.col(text))).alias("text"))
    return each.select(F.substring(F.sha1("text"), 1, 12).alias("id"), F.substring("text", 1, 120).alias("title"), "text")


def ingest_shards(spark: SparkSession, source: str, schema: str, text: str, corpus: str, checkpoint: str, files_per_batch: int = 8, byte_target: int | None = None) -> StreamingQuery:
    """Append the chunks of new shards to a corpus, each id once; runs until no shard is left.

    Progress is in the checkpoint; a batch that is run again finds its ids in the corpus already.
    With ``byte_target`` the job ends behind the batch that reaches it: batches are whole shards
    (``files_per_batch`` bounds them), so no row of a shard that was taken is lost, and shards
    that were not taken come in the next run.
    """
    taken = [0]

    def append(batch: DataFrame, _: int) -> None:
        fresh = chunks(batch, text).dropDuplicates(["id"])
        try:
            known = spark.read.parquet(corpus).select("id")
            fresh = fresh.join(known, "id", "left_anti")
        except Exception as missing:  # the first batch finds no corpus
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        if byte_target is not None and taken[0] >= byte_target:
            raise TargetReached(f"{taken[0]} bytes of {byte_target}")  # the batch is not taken: the checkpoint stays before it
        size = Observation()
        fresh.observe(size, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).write.mode("append").parquet(corpus)
        taken[0] += size.get["bytes"]

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TargetReached(Exception):
    """An ingest ended because it had taken enough; what is left comes in the next run."""


def grow(step, wanted: int = 8, per_run: int = 400, known: int = 0, total: int = 20_000, minutes: float = 0.0, clock=time.monotonic) -> tuple[int, int]:
    """Rounds of ``step(count, intents)`` until the run's or the time's budget is used: ``(added, updated)`` in all.

    ``step`` makes up to ``count`` new intents, none if ``intents`` is False (the catalogue has
    ``total``, and only the corpus grows), and returns ``(added, updated)`` or None if it has no
    candidates. Without ``minutes`` there is one round.
    """
    added = updated = 0
    began = clock()
    while not per_run or added < per_run:
        count = min(wanted, per_run - added) if per_run else wanted
        made = step(max(1, count), known + added < total)
        if made is None:
            break
        added, updated = added + made[0], updated + made[1]
        if minutes <= 0 or clock() - began >= minutes * 60:
            break
    return added, updated


class FixedWindowLimiter(StatefulProcessor):
    """``limit`` events in ``seconds`` from a key's first event; then a new window begins."""

    def __init__(self, limit: int = 10, seconds: float = 60.0):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "left int, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        left, until = self.window.get() if self.window.exists() else (0, float("-inf"))
        for pdf in rows:
            pdf = pdf.sort_values("at", kind="stable")
            allowed = []
            for at in pdf["at"]:
                if at >= until:
                    left, until = self.limit, at + self.seconds
                allowed.append(left > 0)
                left = max(0, left - 1)
            yield pdf.assign(allowed=allowed)
        self.window.update((left, until))

    def close(self) -> None:
        pass


class _Windows:
    """The limiter's rule over events sorted by key and time; only the current key's window is held."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.key = limit, seconds, None

    def feed(self, key: object, at: float) -> bool:
        if key != self.key:
            self.key, self.left, self.until = key, 0, float("-inf")
        if at >= self.until:
            self.left, self.until = self.limit, at + self.seconds
        self.left -= 1
        return self.left >= 0


def allow(pdf: pd.DataFrame, limit: int = 10, seconds: float = 60.0) -> pd.DataFrame:
    """The same rule over all events of a key."""
    pdf = pdf.sort_values(["at", "id"], kind="stable")
    windows = _Windows(limit, seconds)
    return pdf.assign(allowed=[windows.feed("", at) for at in pdf["at"]])


def rate_limited(events: DataFrame, id_col: str, key: str, time: str, limit: int = 10, seconds: float = 60.0) -> DataFrame:
    """Batch form: ``id, key, allowed`` for each event.

    A key's events are sorted by Spark and streamed, so a hot key needs no memory of its own.
    """
    rows = events.select(F.col(id_col).alias("id"), F.col(key).alias("key"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = _Windows(limit, seconds)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "allowed": [windows.feed(k, at) for k, at in zip(pdf["key"], pdf["at"])]})

    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, "id long, key long, allowed boolean")


def unique_ids(stream: DataFrame, id_col: str) -> DataFrame:
    """Each id once over the life of the stream."""
    return stream.dropDuplicates([id_col])
