"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question and its re-parameterised
version share their template. Benchmark items give windows of template tokens; a document's
windows are looked up in a hash table of them. Windows of one item on one alignment are put
together, and the alignment counts if it covers enough of the item and the values in its slots
are consistent: each of the item's values is replaced by one value throughout, and different
values stay different. Every occurrence in the document is judged by itself.

A capitalised word that begins a sentence may be a name or not. Windows are indexed under both
readings and looked up under both, so "Tom buys ..." and "Sara buys ..." share a template.

The benchmark is a query set: it is taken in blocks of about ``block_windows`` windows, each
shipped to the executors, and every document is looked up whole in each block. Documents are
never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches

WINDOW, COVERAGE, LITERALS = 8, 0.5, 0.5
BLOCK_WINDOWS = 200_000
#: Units that a number may carry, and number words.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros degree degrees percent mph kmh watt watts volt volts".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half".split())
NAME, NUMBER, UNIT = "\x01name", "\x01number", "\x01unit"
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")


def template(text: str) -> tuple[list[str], list[str], list[bool]]:
    """Template tokens and, aligned with them, the words they stand for (lower case) and whether they may be a name.

    A name is a capitalised word, not all capitals; one that begins a sentence is a literal word
    that may be a name. A unit is a unit word right behind a number. Runs of names are one
    placeholder each word.
    """
    out, values, maybe = [], [], []
    begins = True
    for token in _TOKEN.findall(text):
        first = token[0]
        if first in ".!?\n":
            begins = True
            continue
        low = token.lower()
        named = False
        if first.isdigit() or (low in NUMBER_WORDS):
            kind = NUMBER
        elif out and out[-1] == NUMBER and low in UNITS:
            kind = UNIT
        else:
            kind = low
            if first.isupper() and len(token) > 1 and token[1:].islower():
                named = begins
                kind = low if begins else NAME
        out.append(kind)
        values.append(low)
        maybe.append(named)
        begins = False
    return out, values, maybe


def consistent(pairs: list[tuple[str, str, str]]) -> bool:
    """Whether (type, item value, document value) triples are a one-to-one replacement."""
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    return all(there.setdefault((t, a), b) == b and back.setdefault((t, b), a) == a for t, a, b in pairs)


class Block:
    """A block of benchmark items: window to its places, and the items' templates.

    Tokens are numbers of the block's own vocabulary, so a document's windows with any other
    word are passed over.
    """

    def __init__(self, items: list[tuple[object, str]], window: int, literals: float):
        self.window = window
        self.items, self.places, self.by_value = [], defaultdict(list), defaultdict(list)
        self.words: dict[str, int] = {NAME: 0}
        for item_id, text in items:
            tokens, values, maybe = template(text or "")
            if not tokens:
                continue
            k = len(self.items)
            size = min(window, len(tokens))
            ids = [self.words.setdefault(t, len(self.words)) for t in tokens]
            starts = range(len(tokens) - size + 1)
            # windows of hardly any literal words would match anything; an item of nothing else is matched by its values
            useful = 0
            for i in starts:
                found = False
                for key in product(*((ids[j], 0) if maybe[j] else (ids[j],) for j in range(i, i + size))):
                    literal = sum(x != 0 and tokens[i + d][0] != "\x01" for d, x in enumerate(key))
                    if literal >= literals * size:
                        self.places[key].append((k, i))
                        found = True
                useful += found
            if not useful:
                for i in starts:
                    self.by_value[tuple(values[i : i + size])].append((k, i))
            self.items.append((item_id, tokens, values, useful or len(starts), maybe))
        self.sizes = sorted({len(w) for w in self.places})
        self.value_sizes = sorted({len(w) for w in self.by_value})

    def found(self, tokens: list[str], values: list[str], maybe: list[bool]) -> dict[tuple[int, int], set[int]]:
        """(item, document place less item place) to the item's windows that are there."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        ids = [self.words.get(t, -1) for t in tokens]
        for size in self.sizes:
            unknown = unsure = -1
            for end, x in enumerate(ids):
                if maybe[end]:
                    unsure = end
                elif x < 0:
                    unknown = end
                i = end - size + 1
                if i < 0 or unknown >= i:
                    continue
                if unsure < i:
                    keys = (tuple(ids[i : end + 1]),)
                else:
                    keys = product(*(((ids[j], 0) if ids[j] >= 0 else (0,)) if maybe[j] else (ids[j],) for j in range(i, end + 1)))
                for key in keys:
                    for k, at in self.places.get(key, ()):
                        found[k, i - at].add(at)
        for size in self.value_sizes:
            for i in range(len(values) - size + 1):
                for k, at in self.by_value.get(tuple(values[i : i + size]), ()):
                    found[k, i - at].add(at)
        return found

    def hits(self, text: str, coverage: float) -> Iterator[tuple[object, int, float, bool, bool]]:
        """For each item found: id, windows, coverage, whether the words are the same, slots that differ."""
        tokens, values, maybe = template(text)
        found = self.found(tokens, values, maybe)
        best: dict[int, tuple] = {}
        joined: dict[int, list] = defaultdict(list)
        for (k, shift), starts in found.items():
            joined[k].append((len(starts), shift, starts))
        for k, runs in joined.items():
            item_id, own, own_values, total, own_maybe = self.items[k]
            runs.sort(key=lambda r: (-r[0], r[1]))
            by_shift = sorted(runs, key=lambda r: r[1])
            shifts = [r[1] for r in by_shift]
            # every alignment leads once; those near it count too: an insertion shifts the rest of the passage
            for lead in runs:
                near = by_shift[bisect_left(shifts, lead[1] - len(own)) : bisect_right(shifts, lead[1] + len(own))]
                if len(set().union(*(r[2] for r in near))) < max(coverage * total, best[k][1] if k in best else 0):
                    continue
                near.sort(key=lambda r: (r is not lead, -r[0], r[1]))
                n, same, changed = self._judged(own, own_values, own_maybe, near, tokens, values, maybe)
                if n and n / total >= coverage and (k not in best or (n, same) > (best[k][1], best[k][3])):
                    best[k] = (item_id, n, n / total, same, changed)
                if k in best and best[k][1] == total and best[k][3]:
                    break
        yield from (best[k] for k in sorted(best))

    def _judged(self, own: list[str], own_values: list[str], own_maybe: list[bool], near: list, tokens: list[str], values: list[str], maybe: list[bool]) -> tuple[int, bool, int]:
        """Windows, whether the words are the same and replaced slots of one occurrence, leading alignment first.

        An alignment near the leading one whose slots don't agree with it belongs to another
        occurrence and is left out; no windows if the leading one doesn't agree with itself.
        """
        size = min(self.window, len(own))
        covered: set[int] = set()
        slots, same = [], True
        for _, shift, starts in near:
            places = sorted({s + d for s in starts - covered for d in range(size)})
            more = list(slots)
            for j in places:
                if own[j][0] == "\x01":
                    more.append((own[j], own_values[j], values[j + shift]))
                elif own_maybe[j] and (maybe[j + shift] or tokens[j + shift] == NAME):
                    more.append((NAME, own_values[j], values[j + shift]))
            if not consistent(more):
                if not covered:
                    break
                continue
            slots = more
            covered |= starts
            same &= all(own_values[j] == values[j + shift] for j in places)
        return len(covered), same, len({(t, a) for t, a, b in slots if a != b})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, literals: float = LITERALS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document row and benchmark item found in it.

    Columns: ``doc_id, item_id, n_windows, coverage, verbatim, n_changed`` (``verbatim``: the
    covered words are the item's own; ``n_changed``: distinct slot values that were replaced), of
    the occurrence that has most windows.
    Null or empty texts match nothing, nor do items without words. An item shorter than the
    window is one window; an item of placeholders only is matched by its values. Rows repeated
    in either table give repeated hits. An empty table on either side gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, n_windows int, coverage double, verbatim boolean, n_changed int"
    pair = docs.select(docs[id_col], docs[text_col].cast("string"))
    out = None
    for items in _blocks(benchmark.select(benchmark[item_col], benchmark[item_text].cast("string")), block_windows):
        held = spark.sparkContext.broadcast(Block(items, window, literals))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            kinds = [to_arrow_type(id_type), to_arrow_type(item_type), pa.int32(), pa.float64(), pa.bool_(), pa.int32()]
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in held.value.hits(text.as_py() or "", coverage)]
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "n_windows", "coverage", "verbatim", "n_changed"])

        part = map_batches(pair, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(items: DataFrame, block_windows: int) -> Iterator[list[tuple]]:
    """The benchmark, partition by partition, in lists of about ``block_windows`` tokens."""
    block, words = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        words += len(_TOKEN.findall(row[1] or "")) + 1
        if words >= block_windows:
            yield block
            block, words = [], 0
    if block:
        yield block


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, literals: float = LITERALS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The input rows in which no benchmark item is found; columns as given, whatever their names.

    Every row is judged by itself, so a row that shares its id with a contaminated one stays. A
    null text is clean; without items all rows stay; an empty table gives no rows.
    """
    at, out = docs.columns.index(text_col), docs
    for items in _blocks(benchmark.select(benchmark[item_col], benchmark[item_text].cast("string")), block_windows):
        held = docs.sparkSession.sparkContext.broadcast(Block(items, window, literals))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(held.value.hits(str(text.as_py() or ""), coverage), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = map_batches(out, run, docs.schema)
    return out
