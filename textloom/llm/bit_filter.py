"""A Bloom filter of fixed size as a small table, with DataFrame functions only.

The filter has ``2**25`` bits (4 MB) whatever it is made of, in rows of 64-bit words: the low
bits of a key's hash name the row and the word, further bits the three bits of that word.
A key that was put in is always found. The more keys are in, the more others are let by, so that
what stands behind the filter must hold without it: it only saves work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import materialise

ROW_BITS, WORD_BITS = 9, 10


def _part(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int")


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, ROW_BITS).bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")


def _mask(h: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(3):
        bit = F.shiftrightunsigned(h, ROW_BITS + WORD_BITS + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bit_filter(hashes: DataFrame, write: bool = False) -> DataFrame:
    """``part, words`` of the 64-bit hashes in the column ``h``: 512 rows of 1,024 words.

    A filter that is asked more than once is to be written, else it is made for its broadcast.
    """
    h = F.col("h")
    every = hashes.sparkSession.range(1 << (ROW_BITS + WORD_BITS)).select(_part(F.col("id")).alias("part"), _word(F.col("id")).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = hashes.select(_part(h).alias("part"), _word(h).alias("word"), _mask(h).alias("bits")).unionByName(every).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return materialise(rows.coalesce(2), "bit-filter") if write else rows


def _tested(rows: DataFrame, h: Column, known: DataFrame, passes: bool) -> DataFrame:
    looked_up = rows.withColumn("__h", h).join(F.broadcast(known.select(F.col("part").alias("__part"), F.col("words").alias("__words"))), _part(F.col("__h")) == F.col("__part"))
    mask = _mask(F.col("__h"))
    found = F.get("__words", _word(F.col("__h"))).bitwiseAND(mask) == mask
    return looked_up.where(found if passes else ~found).drop("__h", "__part", "__words")


def may_contain(rows: DataFrame, h: Column, known: DataFrame) -> DataFrame:
    """The rows whose hash may be in the filter: all that are, and few others."""
    return _tested(rows, h, known, True)


def surely_absent(rows: DataFrame, h: Column, known: DataFrame) -> DataFrame:
    """The other rows: their hash is not in the filter."""
    return _tested(rows, h, known, False)
