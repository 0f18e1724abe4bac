"""Byte-level BPE by longest match with backtracking.

The vocabulary's tokens, their bytes read as Latin-1, form an Aho-Corasick automaton that
gives the longest token at every position. An encoding is the exact result of the merges if
and only if each two neighbouring tokens are the merges' result for their joint bytes, so the
encoder walks forward by longest match, shortens a token that does not fit its neighbour, and
marks positions from which nothing fits; each position is left at most once, which makes the
work linear. Whether two tokens fit is found once by running the merges, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches
from textloom.llm.char_classes import as_known


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as this machine's unsigned integers, which must be little-endian of 32 bits")


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (under a few MB), for shipping to executors."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges themselves: join the lowest-ranked neighbouring pair, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _Packed(dict):
    """Pieces of texts to their ids as little-endian unsigned 32-bit integers; bounded, filled on demand.

    When full, the entries become the old generation; what is asked for again comes back from it.
    """

    def __init__(self, pack, limit: int, longest: int = 64):
        super().__init__()
        self.pack, self.limit, self.longest, self.old = pack, limit, longest, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.pack(piece)
            if len(piece) > self.longest:
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.sizes = [len(token) for token in self.tokens]
        self.matcher.make_automaton()
        self.shorter = {rank: next((ranks[t] for n in range(len(token) - 1, 0, -1) if (t := token[:n]) in ranks), None) for token, rank in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(pattern)
        self.packed = _Packed(self.pack, 250_000)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave exactly these two tokens of their joint bytes; remembered."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 300_000:
                self.fits.clear()
            known = self.fits[left, right] = merge_by_rank(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size = len(piece), self.sizes
        longest: list[int | None] = [None] * (n + 1)
        for end, rank in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank  # ends only grow, so the longest comes last
        open_at = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_at[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at, token = end, longest[end]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                open_at[at] = 0
                token = ids.pop()
                at -= size[token]
        return ids

    def pieces(self, text: str) -> list[str]:
        """The matches of the split pattern; characters that the library doesn't know are neither letters nor numbers."""
        known = as_known(text)
        return self.split.findall(text) if known is text else [text[m.start() : m.end()] for m in self.split.finditer(known)]

    def pack(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def forget(self) -> None:
        """Empty the remembered results."""
        self.packed.forget()
        self.fits.clear()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


_BUILT: dict[str, ByteBPE] = {}


def encoder(data: bytes, pattern: str) -> ByteBPE:
    """The encoder of this worker process, built once for each vocabulary."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = ByteBPE(parse_ranks(data), pattern)
    return _BUILT[key]


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, forget: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, with ``with_ids``, ``ids``
    (packed, as ``encode`` gives them) and ``decoded_ok``. A null text is empty: no tokens.
    Rows are independent, so order, repeats, ties and further columns do not matter; a text
    of any length is encoded whole. ``ranks`` is the rank file (a few MB at most), which is
    shipped to the executors. Workers empty what they remember of a task when it ends, unless
    ``forget`` is off, for jobs that do nothing else.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    id_type = docs.schema[id_col].dataType.simpleString()
    more = ", ids binary, decoded_ok boolean" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(held.value, pattern)
        for batch in batches:
            counts, id_hashes, text_hashes, packs, good = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                packed = bpe.encode(text)
                decoded = bpe.decode(packed)
                counts.append(len(packed) // 4)
                id_hashes.append(hashlib.sha256(packed).hexdigest())
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    packs.append(packed)
                    good.append(decoded == text.encode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(packs, pa.binary()), pa.array(good, pa.bool_())]
                names += ["ids", "decoded_ok"]
            yield pa.RecordBatch.from_arrays(columns, names)
        if forget:
            bpe.forget()

    pair = docs.select(docs[id_col], F.col(text_col).cast("string"))
    return map_batches(pair, run, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
