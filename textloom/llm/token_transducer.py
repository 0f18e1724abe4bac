"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is turned into a deterministic transducer over characters. Its
states join the place in the split pattern with the place inside the current piece: for every
token boundary that a longer piece may still use, the trie node of the bytes since then, the
token before it, and the tokens counted up to it beyond those already emitted. Each transition
carries the number of tokens it emits, each state what it emits at the end. States are compiled
when first reached and the table is bounded; emptying it changes no result.

A text is cut into blocks anywhere. A block's state map takes the state in front of it to the
state behind it and a count: at a non-space followed by white space every piece ends, so past
its first such point the map is constant. Maps compose associatively, so the blocks of a text
combine in a prefix scan (``scan``). A count needs its last prefix only: the query takes the
scan's up-sweep (``fold``), pairs by pairs, within the task that has the text.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches
from textloom.llm.char_classes import char_class, chunks

#: Endings that the split pattern takes after an apostrophe (fixed values).
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = {"r": "e", "v": "e", "l": "l"}
BLOCK_CHARS = 16_384


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files."""
    direct = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(direct)]
    return {chr(b): b for b in direct} | {chr(256 + k): b for k, b in enumerate(rest)}


class State(dict):
    """Characters to (next state, emitted tokens), filled when first asked for."""

    __slots__ = ("machine", "key", "final")

    def __init__(self, machine: Transducer, key: tuple):
        super().__init__()
        self.machine, self.key = machine, key
        self.final = machine.ending(key)

    def __missing__(self, c: str) -> tuple[State, int]:
        key, emitted = self.machine.move(self.key, c)
        self[c] = found = (self.machine.state(key), emitted)
        self.machine.transitions += 1
        return found


class StateMap(NamedTuple):
    """A block as a function of the state in front of it.

    ``lead`` is run from that state; if ``closed``, pieces end there, ``count`` tokens follow
    and the state behind is ``after`` whatever came in.
    """

    lead: str
    closed: bool = False
    count: int = 0
    after: State | None = None


class Transducer:
    """A byte-level BPE vocabulary compiled, as far as needed, to a deterministic transducer."""

    def __init__(self, spec: bytes, max_transitions: int = 800_000, max_words: int = 350_000, max_fits: int = 300_000):
        model = json.loads(spec)
        if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser is compiled")
        byte_of, vocab = printable_bytes(), model["model"]["vocab"]
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))).split if self.special else None
        self.tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t) and t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.single = {t[0]: i for i, t in self.tokens.items() if len(t) == 1}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, token in self.tokens.items():
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = i
        self.max_transitions, self.max_words, self.max_fits = max_transitions, max_words, max_fits
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self.empty = ((0, -1, 0),)
        self.reset()

    # --- inside a piece -----------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            found = min(((self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if found is None:
                break
            k = found[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens (or, with left -1, the one) as they are."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= self.max_fits:
                self.fits.clear()
            own = [right] if left < 0 else [left, right]
            known = self.fits[left, right] = self.merged(b"".join(self.tokens[i] for i in own)) == own
        return known

    def feed(self, piece: tuple, data: bytes) -> tuple[tuple, int]:
        """Move on by bytes; the tokens that no continuation can undo are emitted."""
        emitted = 0
        for b in data:
            alive, end = [], None
            for node, last, count in piece:
                child = self.children[node].get(b)
                if child is None:
                    continue
                token = self.token_at[child]
                if token >= 0 and end is None and self.fit(last, token):
                    end = (0, token, count + 1)
                if self.children[child]:
                    alive.append((child, last, count))
            alive.append(end)
            base = min(x[2] for x in alive)
            piece = tuple((n, t, c - base) for n, t, c in alive)
            emitted += base
        return piece, emitted

    # --- the split pattern -------------------------------------------------------------------

    def start(self, c: str) -> tuple[tuple, int]:
        """The first character of a piece."""
        kind = char_class(c)
        if kind == "S":
            return ("S", self.empty, c), 0
        piece, emitted = self.feed(self.empty, c.encode("utf-8", "surrogatepass"))
        return ("A" if c == "'" else kind, piece, ""), emitted

    def move(self, key: tuple, c: str) -> tuple[tuple, int]:
        """Next key and emitted tokens. Contexts: '' start, L N O runs, S white space with its last character pending, A apostrophe."""
        context, piece, pending = key
        if context == "":
            return self.start(c)
        kind = char_class(c)
        data = c.encode("utf-8", "surrogatepass")
        if context == "S":
            if kind == "S":
                piece, emitted = self.feed(piece, pending.encode())
                return ("S", piece, c), emitted
            done = piece[-1][2]
            if pending == " ":
                piece, emitted = self.feed(self.empty, b" " + data)
                return (kind, piece, ""), done + emitted
            alone, emitted = self.feed(self.empty, pending.encode())
            key, more = self.start(c)
            return key, done + emitted + alone[-1][2] + more
        if context == "A":
            if pending:
                if LONG_ENDINGS[pending] == c:
                    piece, emitted = self.feed(piece, (pending + c).encode())
                    return ("", self.empty, ""), emitted + piece[-1][2]
                key, emitted = self.start(pending)
                key, more = self.move(key, c)
                return key, piece[-1][2] + emitted + more
            if c in SHORT_ENDINGS:
                piece, emitted = self.feed(piece, data)
                return ("", self.empty, ""), emitted + piece[-1][2]
            if c in LONG_ENDINGS:
                return ("A", piece, c), 0
            context = "O"
        if kind == context:
            piece, emitted = self.feed(piece, data)
            return (context, piece, ""), emitted
        key, emitted = self.start(c)
        return key, piece[-1][2] + emitted

    def ending(self, key: tuple) -> int:
        """Tokens emitted if the text ends here."""
        context, piece, pending = key
        if pending and context == "S":
            piece, emitted = self.feed(piece, pending.encode())
            return emitted + piece[-1][2]
        if pending:
            (_, alone, _), emitted = self.start(pending)
            return piece[-1][2] + emitted + alone[-1][2]
        return piece[-1][2]

    # --- states and maps ---------------------------------------------------------------------

    def reset(self) -> None:
        """Forget compiled states; they are compiled again when needed."""
        self.states: dict[tuple, State] = {}
        self.transitions = 0
        self.initial = self.state(("", self.empty, ""))

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key)
        return found

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Follow the transitions of a text."""
        count = 0
        for c in text:
            state, emitted = state[c]
            count += emitted
        if self.transitions > self.max_transitions:
            key = state.key
            self.reset()
            state = self.state(key)
        return state, count

    def word(self, chunk: str) -> int:
        """Tokens of a chunk that begins and ends where pieces do: a constant map, remembered."""
        state, count = self.run(self.initial, chunk)
        count += state.final
        if len(chunk) <= 64:
            if len(self.words) >= self.max_words:
                self.words.clear()
            self.words[chunk] = count
        return count

    def block_map(self, block: str) -> StateMap:
        """The state map of a block of text that was cut anywhere."""
        parts = chunks(block)
        if len(parts) < 2:
            return StateMap(block)
        known, word = self.words, self.word
        count = 0
        for chunk in parts[1:-1]:
            n = known.get(chunk)
            count += word(chunk) if n is None else n
        state, more = self.run(self.initial, parts[-1])
        return StateMap(parts[0], True, count + more, state)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b. Whether pieces end where two blocks meet is seen from the states."""
        if not a.closed:
            return StateMap(a.lead + b.lead, b.closed, b.count, b.after)
        state, count = self.run(a.after, b.lead)
        if b.closed:
            return StateMap(a.lead, True, a.count + count + state.final + b.count, b.after)
        return StateMap(a.lead, True, a.count + count, state)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefixes' maps, by pairs: as many rounds as the logarithm of their number."""
        step = 1
        while step < len(maps):
            maps = [maps[k] if k < step else self.compose(maps[k - step], maps[k]) for k in range(len(maps))]
            step *= 2
        return maps

    def fold(self, maps: list[StateMap]) -> StateMap:
        """The last prefix's map only: the up-sweep of the same scan."""
        while len(maps) > 1:
            pairs = [self.compose(maps[k], maps[k + 1]) for k in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) & ~1 :]
        return maps[0]

    def count(self, text: str, block_chars: int = BLOCK_CHARS) -> int:
        """Tokens of a whole text; each special string is one token."""
        parts = self.split_special(text) if self.split_special else [text]
        total = len(parts) - 1
        for part in parts:
            if not part:
                continue
            whole = self.fold([self.block_map(part[k : k + block_chars]) for k in range(0, len(part), block_chars)])
            state, n = self.run(self.initial, whole.lead)
            total += n + state.final
            if whole.closed:
                total += whole.count + whole.after.final
        return total


_COMPILED: dict[int, Transducer] = {}


def transducer(spec: bytes) -> Transducer:
    """This worker process's transducer, made once for each vocabulary."""
    key = hash(spec)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(spec)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, spec: bytes, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, n_bytes, n_tokens, over_limit`` of the whole text.

    ``spec`` is the tokenizer's JSON file (a few MB at most), shipped to the executors. A null
    text is empty: 0 bytes, 0 tokens, not over the limit. Rows are independent, so repeats,
    ties, null ids and further columns have no effect; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            gc.disable()  # states are many, linked and long-lived; looking through them finds nothing
            try:
                counts = pa.array([machine.count(text.as_py() or "") for text in batch.column(1)], pa.int64())
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], [id_col, "n_bytes", "n_tokens"])

    body = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    counted = map_batches(docs.select(docs[id_col], body.alias("body"), size.alias("n_bytes")), run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
