"""Near-duplicate classes by Order MinHash and banded alignment.

A text's k-mers are its shingles of five words, each labelled with its occurrence number. For
each of many hash functions the sketch takes the few smallest labelled k-mers and keeps them in
the order in which the text has them, so that texts agree in an entry about as often as their
edit similarity says. Entries are combined in bands; texts that share a band are candidates.

Candidates are verified by aligning their shingle sequences within a band around the diagonal,
no wider than the threshold allows, and linked if aligned shingles are at least ``threshold``
of all shingles of both. Classes are the connected components of the links.

Copies of the same words are one node. In a bucket every member is compared with the bucket's
smallest member, so a group of thousands of near copies costs one comparison each.

Buckets that then hold different components are settled by an exact prefix join. In any fixed order of all shingles, two
texts of at least ``threshold`` share one of the first ``n - ceil(threshold * n) + 1`` of the
larger and of the first ``n - ceil(2 threshold / (1 + threshold) * n) + 1`` of the smaller, and
what stands before the first shared one is lost to the overlap. The order is rarest first, by
counts of all shingles in a table of fixed size, so a text with many shingles of its own is in
nobody's way: only texts that agree nearly enough meet, and no link is lost to a cap.

Texts of few shingles are too coarse for bands; their buckets are their prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches
from textloom.llm.bit_filter import bit_filter, may_contain, surely_absent
from textloom.llm.components import components
from textloom.storage import materialise

K, THRESHOLD = 5, 0.8
#: Minima in an entry, entries in a band, bands: 0.8 similar texts share a band with probability 0.993 or more.
MINIMA, ROWS, BANDS = 3, 3, 36
#: Texts of at most so many shingles are found by their prefixes and not by bands.
SHORT = 40
#: Counters of the table by which shingles are ordered; it has the same size for any corpus.
SLOTS = 1 << 18
#: Shingles before each one of a prefix that are looked at to make a pair at its first shared shingle only.
BEFORE = 12
#: Word hashes that a worker remembers.
KNOWN_WORDS = 100_000
#: Numbers that hold a bitmap of shingle parities, 64 bits each.
SIGNS = 9
_M1, _M2, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)
_TOP = np.uint64(2**64 - 1)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ")


def text_key(text: Column, words: Column) -> Column:
    """Key of a node: same words; a text without words is a node of its own text."""
    return F.unhex(F.md5(F.when(words == "", F.concat(F.lit("\x01"), F.coalesce(text.cast("string"), F.lit("")))).otherwise(words)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHash()


def shingles(words: str, k: int = K) -> np.ndarray:
    """64-bit hashes of the shingles in text order; a shorter text is one shingle."""
    parts = words.split(" ") if words else []
    h = np.fromiter(map(_WORDS.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = out * _MUL + h[j : j + n]
    return _mix(out)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with their occurrence number."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    if len(first) == len(h):
        return h
    occurrence = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    out = np.empty_like(h)
    out[order] = _mix(s + occurrence.astype(np.uint64) * _M1)
    return out


class Sketcher:
    """Order MinHash bands of shingle sequences."""

    def __init__(self, minima: int = MINIMA, rows: int = ROWS, bands: int = BANDS, seed: int = 1):
        self.minima, self.rows, self.bands = minima, rows, bands
        rng = np.random.default_rng(seed)
        m = rows * bands
        self.mul = rng.integers(0, 2**63, size=(m, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 2**64, size=(m,), dtype=np.uint64)

    def entries(self, h: np.ndarray) -> np.ndarray:
        """For each hash function the smallest of these labelled shingles, in text order, as one hash."""
        n, take, m = len(h), min(self.minima, len(h)), len(self.salt)
        places = np.empty((m, take), dtype=np.int64)
        step = max(1, 2_000_000 // n)
        for lo in range(0, m, step):
            x = h[None, :] * self.mul[lo : lo + step]
            own = np.arange(len(x))
            for j in range(take):
                places[lo : lo + step, j] = least = x.argmin(axis=1)
                x[own, least] = _TOP
        places.sort(axis=1)
        entry = self.salt.copy()
        for j in range(take):
            entry = _mix(entry * _MUL + h[places[:, j]])
        return entry

    def bands_of(self, entry: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of entries."""
        entry = entry.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _M1
        for j in range(self.rows):
            key = _mix(key * _MUL + entry[:, j])
        return key


def prefix_length(n: int, threshold: float) -> int:
    """Of so many shingles, in any fixed order, a text of at least ``threshold`` has one of the first this many."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def rarest_first(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Labelled shingles by their slot's count, then by value: the same order in every text."""
    return h[np.lexsort((h, counts[(h % np.uint64(SLOTS)).astype(np.int64)]))]


def parities(h: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of labelled shingles, by residue: two differ in at most as many bits as the texts in shingles."""
    bits = np.bincount((h % np.uint64(64 * SIGNS)).astype(np.int64), minlength=64 * SIGNS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence along diagonals at most ``band`` off, bit-parallel.

    Exact whenever the sequences differ by at most ``band`` insertions and deletions.
    """
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[:n] != b[:n])
    head = int(diff[0]) if len(diff) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(diff[0]) if len(diff) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for i, x in enumerate(a):
        match = at.get(x)
        if match:
            lo = max(0, i - band)
            match &= ((1 << (i + band + 1)) - 1) >> lo << lo
            u = v & match
            v = ((v + u) | (v - u)) & full
    return head + tail + len(b) - v.bit_count()


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned shingles over all shingles of both; 0 where it is below the threshold for certain."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    least = threshold * (n + m) / (1 + threshold)
    if np.isin(a, b).sum() < least - 1e-9 or np.isin(b, a).sum() < least - 1e-9:
        return 0.0
    common = banded_lcs(a, b, int(n + m - 2 * least) + 1)
    return common / (n + m - common)


def _slot_counts(slots: DataFrame) -> np.ndarray:
    """The table of counts of (slot, n) rows; its size doesn't depend on the corpus."""
    found = slots.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int32)
    counts[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    return counts


def _sketch(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Rows with their node, number of shingles, bands and, of short texts, all labelled shingles."""
    words = words_of(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), words.alias("words")).select("id", text_key(F.col("text"), F.col("words")).alias("node"), "words")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, seen = Sketcher(), {}
        for batch in batches:
            made = []
            for node, words in zip(batch.column(1).to_pylist(), batch.column(2)):
                if (known := seen.get(node)) is None:
                    h = labelled(shingles(words.as_py()))
                    bands = sketcher.bands_of(sketcher.entries(h)).view(np.int64) if len(h) > SHORT else None
                    known = (len(h), bands, h.view(np.int64) if 0 < len(h) <= SHORT / threshold + 1e-9 else None)
                    if len(seen) >= 10_000:
                        seen.clear()
                    seen[node] = known
                made.append(known)
            columns = list(zip(*made)) if made else [[]] * 3
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "node", "size", "bands", "short"])
        _WORDS.clear()

    return map_batches(rows, run, f"id {id_type}, node binary, size int, bands array<bigint>, short array<bigint>")


def _short_prefixes(nodes: DataFrame, threshold: float) -> DataFrame:
    """``key, node, size`` for each shingle in the prefix of each short text."""
    short = nodes.where("short is not null").select("node", "size", "short")
    slots = short.select(F.explode("short").alias("h")).select((F.col("h").bitwiseAND(F.lit(SLOTS - 1))).alias("slot"), F.lit(1).cast("long").alias("n"))
    held = nodes.sparkSession.sparkContext.broadcast(_slot_counts(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for h in batch.column(2):
                h = np.array(h.as_py(), dtype=np.int64).view(np.uint64)
                keys.append(rarest_first(h, held.value)[: prefix_length(len(h), threshold)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"])

    return map_batches(short, run, "node binary, size int, keys array<bigint>").select(F.explode("keys").alias("key"), "node", "size")


def _sizes_fit(threshold: float) -> Column:
    return F.least("size", "size_b") >= threshold * F.greatest("size", "size_b")


def _prefix_pairs(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b, la, lb``: pairs of the nodes in ``rest`` that can reach the threshold, with their different labels.

    Every such pair meets at its first shared shingle, within both prefixes; then the bitmaps of
    both leave out what differs in too many shingles for certain.
    """

    left = materialise(rest.join(texts, "node").select("node", "label", "size", "words"), "omh-left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for words in batch.column(0):
                slot, n = np.unique((labelled(shingles(words.as_py())) % np.uint64(SLOTS)).astype(np.int64), return_counts=True)
                counts[slot] += n
        _WORDS.clear()
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(counts[slot])], ["slot", "n"])

    held = texts.sparkSession.sparkContext.broadcast(_slot_counts(map_batches(left.select("words"), count, "slot bigint, n bigint")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths, own = [], [], []
            for words in batch.column(3):
                h = rarest_first(labelled(shingles(words.as_py())), held.value)
                n = prefix_length(len(h), threshold)
                keys.append(h[:n].view(np.int64))
                lengths.append(n)
                own.append(np.arange(n) < prefix_length(len(h), 2 * threshold / (1 + threshold)))
            if not keys:
                continue
            keys, lengths = np.concatenate(keys), np.array(lengths)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            many = np.minimum(pos, BEFORE)
            ends = np.cumsum(many)
            before = keys[np.arange(many.sum()) + np.repeat(np.arange(len(keys)) - ends, many)]
            before = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(before))
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            same = [batch.column(c).take(at) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *same, pa.array(pos, pa.int32()), pa.array(np.concatenate(own)), before], ["key", "node", "label", "size", "pos", "own", "before"])
        _WORDS.clear()

    every = materialise(map_batches(left, prefixes, "key bigint, node binary, label binary, size int, pos int, own boolean, before array<bigint>"), "omh-prefixes")
    tag = F.xxhash64("label")
    mixed = every.groupBy("key").agg(F.min(tag).alias("lo"), F.max(tag).alias("hi"), F.max("own").alias("own")).where("lo <> hi and own").select("key")
    mixed = materialise(mixed, "omh-mixed")
    met = may_contain(every, F.xxhash64("key"), bit_filter(mixed.select(F.xxhash64("key").alias("h"))))
    met = materialise(met.join(mixed, "key"), "omh-met")
    small = met.where("own").select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "size", "pos", "before")])
    ordered = (F.col("size_b") < F.col("size")) | ((F.col("size_b") == F.col("size")) & (F.col("node_b") < F.col("node")))
    rest_fits = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b")) >= (F.col("size") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    first = ~F.arrays_overlap("before", "before_b")  # else the pair is made there
    pairs = met.join(small, "key").where(ordered & (F.col("label") != F.col("label_b")) & _sizes_fit(threshold) & rest_fits & first)
    pairs = pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("label").alias("la"), F.col("label_b").alias("lb"), (F.col("size") + F.col("size_b")).alias("both")).distinct()

    names = [f"g{k}" for k in range(SIGNS)]

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([parities(labelled(shingles(words.as_py()))) for words in batch.column(3)], dtype=np.int64).reshape(-1, SIGNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(bits[:, k]) for k in range(SIGNS))], ["node", *names])
        _WORDS.clear()

    signed = materialise(map_batches(left, signs, "node binary, " + ", ".join(f"{g} bigint" for g in names)), "omh-signs")
    for side in "ab":
        pairs = pairs.join(signed.select(F.col("node").alias(side), *[F.col(g).alias(f"{side}{g}") for g in names]), side)
    differ = reduce(lambda x, g: x + F.bit_count(F.col(f"a{g}").bitwiseXOR(F.col(f"b{g}"))), names, F.lit(0))
    fits = differ <= F.col("both") * ((1 - threshold) / (1 + threshold)) + 1e-6
    return pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (a, b) whose alignment reaches the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("words_a"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("words_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known, last = [], None, None
            for wa, wb in zip(batch.column(2), batch.column(3)):
                wa, wb = wa.as_py(), wb.as_py()
                if wa != last:
                    last, known = wa, shingles(wa)
                keep.append(alignment_similarity(known, shingles(wb), threshold) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
        _WORDS.clear()

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "words_a", "words_b")
    return map_batches(joined, run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col, class_id, class_size, kept, node``.

    ``class_id`` is the smallest id of the class, ``kept`` marks its row, ``class_size`` counts
    rows, ``node`` (hex) is shared by texts of the same words. A null text is empty; a text
    without words is only near to an equal text. A null id is used only for a class without
    other ids. Rows that repeat id and text are the same document and marked alike; of different
    texts with the smallest id one is kept. An empty
    table gives no rows; further columns are ignored.
    """
    rows = materialise(_sketch(docs, id_col, text_col, threshold), "omh-rows")
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("size", "bands", "short")])
    nodes = materialise(nodes, "omh-nodes")

    buckets = nodes.where("size > 0").select(F.explode("bands").alias("key"), "node", "size").unionByName(_short_prefixes(nodes, threshold))
    # what is joined to a bucket's members is a table, so that a hot bucket can be split in the join
    shared = materialise(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "omh-shared")
    members = materialise(may_contain(buckets, F.xxhash64("key"), bit_filter(shared.select(F.xxhash64("key").alias("h")))).join(shared, "key"), "omh-buckets")

    wanted = materialise(members.select("node").distinct().join(nodes.select("node", F.col("id").alias("own")), "node"), "omh-wanted")
    # only documents that the filter lets by are shuffled to be joined
    source = may_contain(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), F.xxhash64("id"), bit_filter(wanted.select(F.xxhash64("own").alias("h"))))
    # joined by id alone and written, so that only wanted texts are taken apart; by a merge at every size
    wanted = wanted.withColumnRenamed("node", "want").hint("merge")
    found = materialise(source.join(wanted, source["id"].eqNullSafe(wanted["own"])).select("want", "text"), "omh-found").withColumn("words", words_of(F.col("text")))
    texts = found.where(F.col("want") == text_key(F.col("text"), F.col("words"))).groupBy(F.col("want").alias("node")).agg(F.first("words").alias("words"))
    texts = materialise(texts, "omh-texts")

    centre = members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("c"))
    centre = materialise(centre.select("key", F.col("c.node").alias("b"), F.col("c.size").alias("size_b")), "omh-centres")
    star = members.join(centre, "key").where((F.col("node") != F.col("b")) & _sizes_fit(threshold))
    tested = materialise(star.select(F.col("b").alias("a"), F.col("node").alias("b")).distinct(), "omh-star")  # the centre is the smaller
    labels = components(materialise(_verified(tested, texts, threshold), "omh-links"))
    rest, joined = _unsettled(members, labels), None
    if not rest.isEmpty():
        pairs = materialise(_prefix_pairs(rest, texts, threshold).join(tested, ["a", "b"], "left_anti"), "omh-pairs")
        # first one pair for each two components, then all others of those that are still apart
        few = materialise(pairs.groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "omh-few")
        found = materialise(_verified(few, texts, threshold), "omh-links")
        apart = pairs.join(few, ["a", "b"], "left_anti")
        if not found.isEmpty():
            joined = _joined_components(found, labels)
            now = lambda c: joined.select(F.col("label").alias(c), F.col("to_label").alias(f"{c}_now"))
            apart = apart.join(now("la"), "la", "left").join(now("lb"), "lb", "left").where(F.coalesce("la_now", "la") != F.coalesce("lb_now", "lb"))
        more = materialise(_verified(apart.select("a", "b"), texts, threshold), "omh-links")
        if not more.isEmpty():
            joined = _joined_components(found.unionByName(more), labels)

    spread = nodes.select("node", "id", "n")
    spread = spread.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if joined is not None:
        spread = spread.join(joined, "label", "left").withColumn("label", F.coalesce("to_label", "label")).drop("to_label")
    head = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "node")))["node"], F.min("node"))
    classes = spread.groupBy("label").agg(F.min("id").alias("class_id"), head.alias("head"), F.sum("n").alias("class_size")).where("class_size > 1")
    known = spread.join(classes, "label").select("node", "class_id", "class_size", (F.col("node") == F.col("head")).alias("first"))
    out = rows.select("id", "node").join(known, "node", "left")
    own = F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id"))
    kept = F.col("id").eqNullSafe(own) & F.coalesce("first", F.lit(True))
    out = out.select("id", own.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), kept.alias("kept"), F.lower(F.hex("node")).alias("node"))
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "kept", "node")


def _joined_components(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, to_label``: components that further links join, by one edge for each two of them."""
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    named = found.join(own, "a", "left").join(other, "b", "left")
    edges = named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("label"), F.col("label").alias("to_label"))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label, size`` of the members of the buckets that hold more than one component."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = materialise(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "omh-mixed")
    return materialise(named.join(mixed, "key").select("node", "label", "size").distinct(), "omh-rest")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input rows without those of a class that are not its smallest id; columns as given.

    Rows are joined by id; only where an id is to go is the text looked at again.
    """
    gone = near_duplicates(docs, id_col, text_col, threshold).where("not kept").groupBy(F.col(id_col).alias("gone_id")).agg(F.collect_set(F.unhex("node")).alias("gone_nodes"))
    gone = materialise(gone, "omh-gone")
    known = bit_filter(gone.select(F.xxhash64("gone_id").alias("h")), write=True)
    keyed = docs.select(F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    perhaps = may_contain(keyed, F.xxhash64("id"), known)
    both = perhaps.join(gone, perhaps["id"].eqNullSafe(gone["gone_id"]), "left")
    stays = F.when(F.col("gone_nodes").isNull(), True).otherwise(~F.array_contains("gone_nodes", text_key(F.col("text"), words_of(F.col("text")))))
    out = both.where(stays).select("row").unionByName(surely_absent(keyed, F.xxhash64("id"), known).select("row"))
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
