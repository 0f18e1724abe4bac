"""Samples, splits and batches with a deterministic order by md5 in place of seeded shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.storage import materialise

MS_PER_PAIR = 7.3927
PAIRS_PER_INTENT = 18.85


def shuffle_key(*columns: str, seed: int = 7) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def coverage_first(pairs: DataFrame, ctx: str, resp: str, budget: int, seed: int = 7) -> DataFrame:
    """One pair of every context before any second one, in all at most ``budget``."""
    key = shuffle_key(ctx, resp, seed=seed)
    rn = F.row_number().over(Window.partitionBy(ctx).orderBy(key, resp))
    return pairs.withColumn("__k", key).withColumn("__later", rn > 1).orderBy("__later", "__k", ctx, resp).limit(budget).drop("__k", "__later")


def balanced(rows: DataFrame, label: str, key: str, cap: int, seed: int = 7) -> DataFrame:
    """As many rows of each of two classes: the smaller class, at most half of ``cap``."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().limit(3).collect()}
    n = min([*sizes.values(), cap // 2]) if len(sizes) == 2 else 0
    if n == 0:
        raise ValueError("both classes must have rows")
    w = Window.partitionBy(label).orderBy(shuffle_key(key, seed=seed), key)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def group_split(rows: DataFrame, group: str, percent: int = 10, seed: int = 7) -> DataFrame:
    """``split`` is val or train, the same for all rows of a group.

    By the hash of the group itself, so that no sort of all groups is needed and a group keeps
    its side when others come; the share is ``percent`` up to chance.
    """
    h = F.conv(F.substring(shuffle_key(group, seed=seed), 1, 8), 16, 10).cast("long")
    return rows.withColumn("split", F.when(h % 100 < percent, "val").otherwise("train"))


def length_batches(rows: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """``batch`` numbers of neighbours in length, and the batch's width.

    Places in the global order come from counts by length, so that rows of one length only are
    numbered together, in parts by the hash of their key.
    """
    parts = 64
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    cells = materialise(rows.groupBy(F.col(length).alias("__l"), part.alias("__p")).agg(F.count(F.lit(1)).alias("n")), "length-cells")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__l", "__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("__before", before).drop("n")
    rn = F.row_number().over(Window.partitionBy("__l", "__p").orderBy(key))
    placed = rows.withColumn("__l", F.col(length)).withColumn("__p", part).withColumn("__rn", rn).join(starts, ["__l", "__p"])
    placed = placed.withColumn("batch", F.floor((F.col("__before") + F.col("__rn") - 1) / size)).drop("__l", "__p", "__rn", "__before")
    return placed.withColumn("width", F.max(length).over(Window.partitionBy("batch")))


def time_budget_pairs(minutes: float, epochs: int, encode_minutes: float = 0.0, ms: float = MS_PER_PAIR) -> int:
    """Pairs that fit three quarters of the time, less encoding."""
    return int((minutes * 0.75 - encode_minutes) / epochs * 60_000 / ms)


def data_budget_pairs(intents: int, cap: int | None = None) -> int:
    n = round(PAIRS_PER_INTENT * intents)
    return min(n, cap) if cap else n


def fingerprint(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One digest of all rows: changes with any value or with the order, not with partitioning."""
    each = F.sha2(F.concat_ws("\x1f", F.col(order).cast("string"), *[F.concat_ws(":", F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), 256)
    pieces = [F.sum(F.conv(F.substring(each, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for k in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *pieces), 256).alias("fingerprint"))
