"""WARC archives with a two-level capture index.

Pages are written as gzip members, one record each: a response, or a revisit of the response
with the same payload. The index sorts reversed-host URL keys into compressed blocks; each
shard of it has a sparse directory with the first key of every block, and one line for each
shard leads to these. A look-up searches the shard lines, then the shard's directory, then the
block, each by bisection, and reads the record's byte range.

Every file is written under the shared folder through a file-system URI, with a name of its own
for each attempt of a task; only files that the written tables name are ever read, so lost or
repeated tasks leave nothing but unused files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import map_batches
from textloom.storage import materialise, scratch_path

BLOCK_LINES, LEVEL, BROADCAST_ROWS = 512, 1, 100_000
DATE = "1970-01-01T00:00:00Z"
_SPLIT = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """Reversed host, then port and the rest: ``org,example)/path?query``."""
    _, found, rest = (url or "").partition("://")
    rest = rest if found else (url or "")
    cut = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest[cut:]


def line_key(url: str | None, page_id: object) -> str:
    """A capture's key: URL key and page id. White space in URLs is escaped."""
    return json.dumps(url_key(url))[1:-1].replace(" ", "%20") + " " + _page(page_id)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: object, url: str | None, payload: bytes, refers_to: object | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit has the response's HTTP header, no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = json.dumps(url or "")[1:-1].replace(" ", "%20")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_page(page_id)}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_page(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + _SPLIT + block + _SPLIT, LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(_SPLIT)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_SPLIT)
    return fields, http, payload


def _page(page_id: object) -> str:
    """An id, whatever its characters, as one word; a null id is another word than any id."""
    return "null" if page_id is None else "id:" + quote(str(page_id), safe="")


def _urn(field: str) -> str | None:
    word = field.removeprefix("<urn:page:").removesuffix(">")
    return None if word == "null" else unquote(word.removeprefix("id:"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row; the table ``key, file, offset, length`` says where.

    Of rows with equal payloads (of at least ``min_bytes``) the smallest id is the response.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.encode(F.coalesce(pages[body_col].cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    sizeable = rows.where(F.octet_length("payload") >= min_bytes)
    repeated = sizeable.groupBy("sha").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep is not null").select("sha", "keep")
    repeated = materialise(repeated, "warc-repeated")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    typed = rows.join(repeated, "sha", "left").select("id", "url", "payload", F.when(F.col("keep") != F.col("id"), F.col("keep")).otherwise(F.when(F.col("id").isNull(), F.col("keep"))).alias("of"))
    folder = scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        name, at, out = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                keys, offsets, lengths = [], [], []
                for page, url, payload, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                    member = make_record(page, url, payload.as_py(), of, of is not None)
                    out = out or store.open_output_stream(name, compression=None)
                    out.write(member)
                    keys.append(line_key(url, page))
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialise(map_batches(typed, run, "key string, file string, offset bigint, length bigint"), "warc-captures")


class CaptureIndex:
    """The index on storage: its folder, and the first key and file of each shard."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.folder, self.shards = folder, sorted(shards)

    @staticmethod
    def build(captures: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        """Sort the captures by key, each range partition a shard of compressed blocks.

        Only one line for each shard comes to the driver: as many as there are partitions.
        """
        spark = captures.sparkSession
        folder = scratch_path(spark, "warc-index")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = fs.FileSystem.from_uri(folder)
            store.create_dir(top)
            name, at, directory, lines, out = f"{top}/{uuid.uuid4().hex}", 0, [], [], None

            def flush() -> None:
                nonlocal at, out, lines
                out = out or store.open_output_stream(f"{name}.cdx.gz", compression=None)
                block = gzip.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6, mtime=0)
                out.write(block)
                directory.append((lines[0][0], at, len(block)))
                at += len(block)
                lines = []

            for batch in batches:
                for line in zip(*(c.to_pylist() for c in batch.columns)):
                    # a key never spans blocks, so that one block holds all its captures
                    if len(lines) >= block_lines and lines[-1][0] != line[0]:
                        flush()
                    lines.append(line)
            if lines:
                flush()
            if out is not None:
                out.close()
                with store.open_output_stream(f"{name}.dir", compression=None) as f:
                    f.write(json.dumps(directory).encode())
                yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first", "name"])

        ordered = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key")
        shards = materialise(map_batches(ordered, run, "first string, name string"), "warc-shards")
        return CaptureIndex(folder, [(r["first"], r["name"]) for r in shards.collect()])


class Searcher:
    """Look-ups in a capture index; keeps one shard directory, one block and a few open archives."""

    def __init__(self, index: CaptureIndex):
        self.store, _ = fs.FileSystem.from_uri(index.folder)
        self.shards, self.firsts = index.shards, [s[0] for s in index.shards]
        self.shard, self.block = None, None
        self.archives: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def captures(self, key: str) -> list[list[str]]:
        """All (key, file, offset, length) of a key, by three bisections and one range read."""
        k = bisect_right(self.firsts, key) - 1
        if k < 0:
            return []
        if self.shard is None or self.shard[0] != k:
            name = self.shards[k][1]
            with self.store.open_input_file(f"{name}.dir") as f:
                directory = json.loads(f.read())
            self.shard, self.block = (k, name, directory, [x[0] for x in directory]), None
        _, name, directory, firsts = self.shard
        b = bisect_right(firsts, key) - 1
        if self.block is None or self.block[0] != b:
            with self.store.open_input_file(f"{name}.cdx.gz") as f:
                lines = [x.split("\t") for x in gzip.decompress(f.read_at(directory[b][2], directory[b][1])).decode().split("\n")]
            self.block = (b, lines, [x[0] for x in lines])
        _, lines, keys = self.block
        return lines[bisect_left(keys, key) : bisect_right(keys, key)]

    def record(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
        """One record by its byte range."""
        if file not in self.archives:
            if len(self.archives) >= 32:
                self.archives.popitem(last=False)[1].close()
            self.archives[file] = self.store.open_input_file(file)
        self.archives.move_to_end(file)
        return parse_record(self.archives[file].read_at(length, offset))


def read_captures(lookups: DataFrame, index: CaptureIndex, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The captures of (id, URL) pairs: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` as strings and longs.

    Pairs are sorted by key so that a task meets each block once. A response whose payload does
    not give its digest raises an error.
    """
    spark = lookups.sparkSession
    held = spark.sparkContext.broadcast(index)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_key(u, p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(held.value)
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for _, file, offset, length in search.captures(key):
                    fields, http, payload = search.record(file, int(offset), int(length))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and payload_digest(payload) != digest:
                        raise ValueError(f"damaged payload at {file}:{offset}")
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]) if revisit else len(payload)
                    page = _urn(fields["WARC-Record-ID"])
                    out.append((page, size, digest, fields["WARC-Type"], _urn(fields["WARC-Refers-To"]) if revisit else None))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wanted = map_batches(lookups.select(lookups[id_col], lookups[url_col].cast("string")), keys, "key string").distinct()
    wanted = wanted.repartitionByRange("key").sortWithinPartitions("key")
    return map_batches(wanted, run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write every page to archives, index them, and read each record back through the index.

    One row per input row: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    A null body is an empty payload, a null URL an empty one; a null id loses to any other as
    response. Rows that repeat an id and payload are all responses if that id is the smallest.
    An empty table gives no rows; further columns are ignored.
    """
    index = CaptureIndex.build(write_archives(pages, id_col, url_col, body_col, min_bytes))
    kind = pages.schema[id_col].dataType
    found = read_captures(pages, index, id_col, url_col)
    return found.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
