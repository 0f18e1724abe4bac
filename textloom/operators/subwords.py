"""Subword statistics and training, Markov counts, and the encoders that apply them.

The distinct words stay on the executors: the driver holds counts of pairs of symbols only, and
plans from them as many merges at once as they settle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import WHITE, token_clean
from textloom.functions.tokens import ascii_tokens
from textloom.storage import materialise

SPECIALS = ("[pad]", "[bos]", "[eos]", "[sep]")
MAX_WORDS = 200_000
#: Pairs whose neighbours are counted for the next round, and merges after which the split words are written again.
NEAR_PAIRS, HELD_MERGES = 128, 40


def word_frequency(docs: DataFrame, text: str, least: int = 1) -> DataFrame:
    """``word, n`` of the cleaned texts."""
    words = docs.select(F.explode(F.split(token_clean(F.col(text)), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def pair_counts(words: DataFrame) -> DataFrame:
    """``a, b, n``: weighted counts of adjacent characters, from ``word, n``."""
    places = F.when(F.length("word") >= 2, F.sequence(F.lit(1), F.length("word") - 1)).otherwise(F.array().cast("array<int>"))
    each = words.select("n", "word", F.explode(places).alias("i")).select("n", F.expr("substring(word, i, 1)").alias("a"), F.expr("substring(word, i + 1, 1)").alias("b"))
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"))


def char_vocabulary(docs: DataFrame, text: str, least: int = 1) -> DataFrame:
    chars = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def train_merges(words: dict[str, int], vocab_size: int, alphabet: list[str], least: int = 2) -> list[tuple[str, str]]:
    """Greedy merges: the most frequent adjacent pair, of equals the smallest, until the vocabulary is full."""
    split = {w: list(w) for w in words}
    counts: Counter = Counter()
    where: dict[tuple[str, str], set[str]] = defaultdict(set)
    for w, parts in split.items():
        for p in zip(parts, parts[1:]):
            counts[p] += words[w]
            where[p].add(w)
    merges: list[tuple[str, str]] = []
    size = len(SPECIALS) + len(alphabet)
    heap = [(-n, p) for p, n in counts.items()]
    heapify(heap)
    while heap and size + len(merges) < vocab_size:
        n, best = heappop(heap)
        if counts.get(best, 0) != -n:  # an old entry; a changed pair has a newer one
            continue
        if -n < least:
            break
        merges.append(best)
        changed = set()
        for w in list(where[best]):
            old, new, i = split[w], [], 0
            while i < len(old):
                if i + 1 < len(old) and (old[i], old[i + 1]) == best:
                    new.append(old[i] + old[i + 1])
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            for p in zip(old, old[1:]):
                counts[p] -= words[w]
                where[p].discard(w)
                if counts[p] <= 0:
                    del counts[p]
                changed.add(p)
            for p in zip(new, new[1:]):
                counts[p] += words[w]
                where[p].add(w)
                changed.add(p)
            split[w] = new
        for p in changed:
            if counts.get(p, 0) > 0:
                heappush(heap, (-counts[p], p))
    return merges


def _merged(ids: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """Symbols of words, 0 between the words, with every merge ``a, b, made`` applied in turn, leftmost first."""
    for a, b, made in merges:
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
        if a == b and len(at):  # of a run every second place
            start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if len(at):
            ids[at] = made
            ids = np.delete(ids, at + 1)
    return ids


def _split_words(words: DataFrame, letters: list[str]) -> DataFrame:
    """``ids, n``: blocks of words as places in ``letters`` from 1, 0 between the words, and their counts."""
    codes = np.array([ord(c) for c in letters], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column(0).to_pylist()
            lengths = np.array([len(w) for w in each], dtype=np.int64)
            own = np.frombuffer("".join(each).encode("utf-32-le"), "<u4")
            ids = np.zeros(len(own) + len(each) + 1, "<u4")
            ids[np.arange(len(own)) + 1 + np.repeat(np.arange(len(each)), lengths)] = np.searchsorted(codes, own) + 1
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([batch.column(1).to_numpy().astype("<i8").tobytes()])], ["ids", "n"])

    return words.select("word", "n").mapInArrow(run, "ids binary, n binary")


def _remerged(blocks: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([_merged(np.frombuffer(ids.as_py(), "<u4").copy(), merges).tobytes()]), pa.array([n.as_py()])], ["ids", "n"])

    return blocks.mapInArrow(run, "ids binary, n binary")


def _counted(blocks: DataFrame, merges: list[tuple[int, int, int]], near: list[tuple[int, int]], size: int) -> tuple[dict, dict, dict]:
    """Counts of all pairs after the merges; of the pairs ``near`` also those of the symbols before and behind them."""
    wanted = np.array(sorted(a * size + b for a, b in near), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, counts in zip(batch.column(0), batch.column(1)):
                ids = _merged(np.frombuffer(held.as_py(), "<u4").copy(), merges).astype(np.int64)
                n = np.append(np.frombuffer(counts.as_py(), "<i8"), 0)[np.cumsum(ids == 0) - 1]
                at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
                keys = ids[at] * size + ids[at + 1]
                found = [(0, keys, n[at])]
                if len(wanted):
                    place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    hit = wanted[place] == keys
                    spot, place = at[hit], place[hit]
                    for kind, beside in ((1, ids[spot - 1]), (2, ids[spot + 2])):
                        inside = beside != 0
                        found.append((kind, place[inside] * size + beside[inside], n[spot[inside]]))
                for kind, keys, weights in found:
                    each, which = np.unique(keys, return_inverse=True)
                    total = np.bincount(which, weights=weights, minlength=len(each)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), kind, np.int32)), pa.array(each), pa.array(total)], ["kind", "key", "n"])

    got = blocks.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    pairs, before, behind = {}, {}, {}
    for kind, key, n in zip(*(c.to_numpy().tolist() for c in got.columns)):
        first, second = divmod(key, size)
        if kind == 0:
            pairs[first, second] = n
        else:
            pair = divmod(int(wanted[first]), size)
            (before if kind == 1 else behind).setdefault(pair, {})[second] = n
    return pairs, before, behind


def _settled(pairs: dict, before: dict, behind: dict, near: set, symbols: list[str], places: dict[str, int], room: int, least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], bool]:
    """The next merges that exact counts settle, the pairs whose neighbours are wanted next, and whether all is done.

    A merge changes only pairs with its left symbol behind or its right symbol before another. Their new counts are known
    where the neighbours of the merged pair are, as long as no merge of this round touched them; else an upper bound is
    kept. The round ends where a pair without an exact count could be the best.
    """
    most, loose, done, old = pairs, set(), [], len(symbols)
    lefts, rights = defaultdict(set), defaultdict(set)
    for a, b in most:
        lefts[b].add(a)
        rights[a].add(b)
    heap = [(-n, symbols[a], symbols[b], a, b) for (a, b), n in most.items()]
    heapify(heap)

    def put(a: int, b: int, n: int, sure: bool) -> None:
        if n <= 0:
            most.pop((a, b), None)
            return
        most[a, b] = n
        lefts[b].add(a)
        rights[a].add(b)
        if not sure:
            loose.add((a, b))
        heappush(heap, (-n, symbols[a], symbols[b], a, b))

    def moved(pair: tuple[int, int], known: int, to: tuple[int, int], sure: bool, n: int) -> None:
        """Of ``pair``, ``known`` places (at most that many if not ``sure``) become the pair ``to``."""
        if not sure:
            known = min(known, n, most[pair])
            loose.add(pair)
        elif pair not in loose:
            put(*pair, most[pair] - known, True)
        put(*to, known, sure)

    over = False
    while heap and len(done) < room:
        n, _, _, a, b = heap[0]
        n = -n
        if most.get((a, b)) != n:  # an old entry; a changed pair has a newer one
            heappop(heap)
            continue
        if n < least:
            over = True
            break
        if (a, b) in loose:
            break
        heappop(heap)
        del most[a, b]
        piece = symbols[a] + symbols[b]
        again = piece in places
        if not again:
            places[piece] = len(symbols)
            symbols.append(piece)
        made = places[piece]
        done.append((a, b, made))
        if again or a == b:  # symbols of another origin, or runs: counted anew
            return done, nlargest(NEAR_PAIRS, most, key=most.get), False
        earlier = done[:-1]
        has = (a, b) in near
        x_before, x_behind = before.get((a, b), {}), behind.get((a, b), {})
        for x in list(lefts[a]):
            if x == b or (x, a) not in most:
                continue
            sure = has and x < old and all(x != q and b != p and (x, a) != (p, q) for p, q, _ in earlier)
            moved((x, a), x_before.get(x, 0) if has and x < old else n, (x, made), sure, n)
        for y in list(rights[b]):
            if y == a or (b, y) not in most:
                continue
            sure = has and y < old and all(y != p and a != q and (b, y) != (p, q) for p, q, _ in earlier)
            moved((b, y), x_behind.get(y, 0) if has and y < old else n, (made, y), sure, n)
        if (b, a) in most:
            loose.add((b, a))
            for to in ((b, made), (made, a), (made, made)):
                put(*to, min(n, most[b, a]), False)
    return done, nlargest(NEAR_PAIRS, most, key=most.get), over or not heap


def learn_merges(words: DataFrame, vocab_size: int, alphabet: list[str], least: int = 2) -> list[tuple[str, str]]:
    """What ``train_merges`` gives for a table ``word, n`` of any size: the words stay on the executors."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set("".join(batch.column(0).to_pylist()))), pa.string())], ["c"])

    words = materialise(words, "bpe-counts")
    symbols = ["", *sorted(r["c"] for r in words.select("word").mapInArrow(letters, "c string").distinct().collect())]
    places = {s: i for i, s in enumerate(symbols) if i}
    blocks = materialise(_split_words(words, symbols[1:]), "bpe-words")
    merges, held, near = [], [], []
    room = vocab_size - len(SPECIALS) - len(alphabet)
    while len(merges) < room:
        if len(held) > HELD_MERGES:
            blocks, held = materialise(_remerged(blocks, held), "bpe-words"), []
        pairs, before, behind = _counted(blocks, held, near, len(symbols))
        done, near, over = _settled(pairs, before, behind, set(near), symbols, places, room - len(merges), least)
        held = held + done
        merges += [(symbols[a], symbols[b]) for a, b, _ in done]
        if over:
            break
    return merges


def train_bpe(docs: DataFrame, text: str, vocab_size: int, alphabet: list[str], least: int = 2, max_words: int | None = MAX_WORDS) -> list[tuple[str, str]]:
    """Merges learned from the ``max_words`` most frequent distinct words; from all words if None."""
    words = word_frequency(docs, text)
    if max_words is not None:
        words = words.orderBy(F.col("n").desc(), "word").limit(max_words)
    return learn_merges(words, vocab_size, alphabet, least)


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges to a word, lowest rank first, leftmost first."""
    parts = list(word)
    while len(parts) > 1:
        found = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if found is None:
            break
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def encode_texts(docs: DataFrame, id_col: str, text: str, merges: list[tuple[str, str]]) -> DataFrame:
    """``id, pieces``: every text's subwords; each distinct word is encoded once, then joined."""
    held = docs.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(merges)})

    @F.pandas_udf("array<string>")
    def encode(words: pd.Series) -> pd.Series:
        return words.map(lambda w: encode_word(w, held.value))

    each = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(token_clean(F.col(text)), " ")).alias("at", "word")).where("word <> ''")
    known = each.select("word").distinct().withColumn("pieces", encode("word"))
    joined = each.join(known, "word").groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pieces"))), lambda x: x["pieces"])).alias("pieces"))
    ids = docs.select(F.col(id_col).alias("id"))
    return ids.join(joined, "id", "left").select("id", F.coalesce("pieces", F.array(F.lit(SPECIALS[0]))).alias("pieces"))


def decode_pieces(pieces: Column) -> Column:
    """The text of pieces, specials left out: no space before a mark, one behind it if a word follows."""
    kept = F.filter(pieces, lambda p: ~F.array_contains(F.array(*[F.lit(s) for s in SPECIALS]), p))
    t = F.regexp_replace(F.array_join(kept, ""), rf"^{WHITE}+|{WHITE}+$", "")
    t = F.regexp_replace(t, rf"{WHITE}+([.,;:!?…)])", "$1")
    return F.regexp_replace(t, r"([.,;:!?…])(?=[a-zçğıöşü0-9])", "$1 ")


def transitions(docs: DataFrame, id_col: str, text: str, head_least: int = 3, edge_least: int = 2) -> DataFrame:
    """``head, next, n``: word successions inside sentences, pruned by head total and edge count."""
    from textloom.functions.text import sentences

    words = docs.select(F.explode(sentences(F.col(text))).alias("sentence")).select(ascii_tokens(F.col("sentence")).alias("w")).where(F.size("w") > 1)
    # neighbours stand in one array: its beginning and its end beside each other, no word is shuffled
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("head"), F.slice("w", F.lit(2), F.size("w") - 1).alias("next"))
    edges = words.select(F.inline(pairs)).groupBy("head", "next").agg(F.count(F.lit(1)).alias("n"))
    heads = edges.groupBy("head").agg(F.sum("n").alias("total")).where(F.col("total") >= head_least)
    return edges.join(heads, "head").where(F.col("n") >= edge_least).select("head", "next", "n")
