"""Keyed merges, upserts and first-wins unions; order is always a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import ascii_fold


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key; rows with a null key go."""
    known = rows.dropna(subset=keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return known.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def chat_key(source: Column, topic: Column, query: Column) -> Column:
    """Source and topic number, or source and folded question where there is none."""
    src = F.coalesce(source, F.lit(""))
    return F.when(topic.isNotNull(), F.concat_ws("\x1f", src, topic.cast("string"))).otherwise(F.concat_ws("\x1f", src, F.lit(""), F.lower(ascii_fold(query))))


def keyed_merge(old: DataFrame, new: DataFrame, key: str, order: str, keep: int = 0) -> DataFrame:
    """Old and new rows by key: the latest value in the place of the first; ``keep`` the last places.

    Adds ``place`` (order of first appearance) and ``added`` (the key is not in ``old``).
    """
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    value = F.struct(*old.columns)
    seq = F.struct("__side", order)
    merged = both.groupBy(F.col(key).alias("__key")).agg(F.max_by(value, seq).alias("v"), F.min(seq).alias("first"))
    out = merged.select("v.*", F.col("first").alias("place"), (F.col("first.__side") == 1).alias("added"))
    return out.orderBy(F.col("place").desc()).limit(keep) if keep else out


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Added and updated rows, as one row."""
    known = old.select(key).distinct().withColumn("known", F.lit(True))
    each = new.join(known, key, "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
    added = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0))
    updated = F.sum(F.when(F.col("known").isNull(), F.col("n") - 1).otherwise(F.col("n")))
    return each.agg(F.coalesce(added, F.lit(0)).alias("added"), F.coalesce(updated, F.lit(0)).alias("updated"))


def ordered_sources(sources: list[DataFrame], key: Column, order: str, limit: int | None = None) -> DataFrame:
    """Sources in order of precedence, the first row of each key; then the first ``limit`` rows."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)])
    out = first_wins(ranked.withColumn("__key", F.nullif(F.lower(key), F.lit(""))), ["__key"], ["source_rank", order]).drop("__key")
    return out.orderBy("source_rank", order).limit(limit) if limit is not None else out


def or_fallback(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """The live rows, or the fallback if there are none."""
    return fallback if live.isEmpty() else live


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The batch's last row for each key over the existing rows; blank keys of the batch go."""
    given = batch.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    return keyed_merge(existing, given, key, order)


def new_rows(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return batch.join(existing.select(key).distinct(), key, "left_anti")


def merge_lists(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Array columns of rows with the same key, joined in order, each value once."""
    out = None
    for c in columns:
        items = rows.select(F.col(key), F.col(order).alias("__o"), F.posexplode(c).alias("__p", "__v"))
        items = items.groupBy(key, "__v").agg(F.min(F.struct("__o", "__p")).alias("__at"))
        made = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]).alias(c))
        out = made if out is None else out.join(made, key, "full")
    return out


def guarded_overwrite(before: DataFrame, after: DataFrame, path: str, max_drop: float = 0.05, force: bool = False) -> float:
    """Write ``after``, unless more than ``max_drop`` of the rows would go; returns the share."""
    n, m = before.count(), after.count()
    drop = (n - m) / n if n else 0.0
    if drop > max_drop and not force:
        raise ValueError(f"{drop:.1%} of {n} rows would be lost, more than {max_drop:.1%}; nothing is written")
    replace_table(after, path)
    return drop


def replace_table(rows: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename, so that readers see the old table or the new one, and ``rows`` may be read from ``path``."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda suffix: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + suffix)
    files = at("").getFileSystem(conf)
    rows.write.mode("overwrite").parquet(path.rstrip("/") + ".staged")
    files.delete(at(".before"), True)
    if files.exists(at("")) and not files.rename(at(""), at(".before")):
        raise OSError(f"{path} can't be moved away; the new rows are in {path}.staged")
    if not files.rename(at(".staged"), at("")):
        files.rename(at(".before"), at(""))
        raise OSError(f"{path}.staged can't take the place of {path}")
    files.delete(at(".before"), True)


def write_nonempty(rows: DataFrame, path: str) -> bool:
    """Append the rows as JSON lines; without rows no file is made."""
    if rows.isEmpty():
        return False
    rows.write.mode("append").json(path)
    return True


def within_budget(rows: DataFrame, order: str, text: str, budget: int) -> DataFrame:
    """Rows in order until their UTF-8 bytes reach the budget (the row that reaches it included).

    A global running sum without a global sort: bytes are summed by range of the order column,
    ranges below the budget pass whole, and the one range where it falls is cut into ranges
    again, until it holds one value of ``order``, of which every row counts as before the budget
    if the first does.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return rows
    before, start, stop = 0, lo, hi
    while start <= stop:  # every round narrows the range a thousandfold
        width = max(1, -(-(stop - start + 1) // 1_000))
        inside = rows.where(F.col(order).between(start, stop))
        sums = inside.groupBy(F.floor((F.col(order) - start) / width).alias("b")).agg(F.sum(size).alias("bytes")).orderBy("b").collect()
        for r in sums:
            if before + r["bytes"] >= budget:
                break
            before += r["bytes"]
        else:
            return rows.where(F.col(order) <= stop)
        start, stop = start + r["b"] * width, min(stop, start + (r["b"] + 1) * width - 1)
        if start == stop:
            break
    return rows.where(F.col(order) <= start) if before < budget else rows.where(F.col(order) < start)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side`` of every key: both, left or right; union, intersection and differences are filters of it."""
    marked = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    kinds = marked.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return kinds.select(key, F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def drift(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose values differ between two versions: added, removed or changed."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, kind.alias("drift")).where("drift is not null")
