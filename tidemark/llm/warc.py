"""WARC archives and a two-level capture index.

Writing: tasks write gzip'd records, one member each, into archives of about ``ARCHIVE_BYTES`` in a shared
folder. Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest page_id is a response and the
others are revisits: HTTP headers without payload, which name the response's record and URL.

Index: captures are sorted by (reversed-host URL key, record id) in range partitions. A partition is a shard: a
file of compressed blocks of ``BLOCK_LINES`` captures and a sparse directory with each block's first key. Above them is
the list of shards. A look-up searches the list, then one directory, both by bisection, inflates the block that may
hold the key and range-reads the record from its archive; only the list of shards is in every task.

Archives are read back sequentially, one file per row; payloads are checked against their digests and revisits are resolved
through the index, once per response they refer to.

A task attempt writes files of its own name, and the captures table names those of the attempts that
count, so a repeated task leaves an orphan but no wrong row. Files are reached by pyarrow file systems,
by URI.

Defined cases: null html is an empty payload; a null url has the key ``)`` and no target line; control
characters of a url are percent-encoded in headers; a null page_id is the largest
(pages without one are all responses if no equal payload has one); rows that repeat the smallest page_id are all
responses; no rows give no archives and no rows.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 512
LEVEL = 3
#: Tasks that read archives back at most; beyond, a task reads several one after another.
MOST_READERS = 10_000
SMALL_ROWS = 100_000
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?")
_PORTS = {"http": "80", "https": "443"}


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then ``)``, path and query; no scheme, user, default port or fragment."""
    if url is None:
        return ")"
    found = _URL.match(url)
    if not found:
        return ")" + url.partition("#")[0]
    scheme, host, port, path, query = found.groups()
    keep = port and port != _PORTS.get((scheme or "").lower())
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if keep else "") + ")" + (path or "/") + (query or "")


def record_id(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page/{page_id}/{digest}"))


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[str, str | None, int] | None) -> bytes:
    """``refers``: record id, URL and page of the response, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers[0]}>"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers[1])}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Record:
    page_id: int | None
    kind: str
    record_id: str
    url: str | None
    payload: bytes
    payload_bytes: int
    digest: str
    refers_id: str | None
    refers_url: str | None


def decode_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(named["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    urn = lambda name: named[name][10:-1] if name in named else None
    page = named.get("X-Page-ID")
    digest = named["WARC-Payload-Digest"].partition(":")[2]
    if named["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {named['WARC-Record-ID']} does not match its digest")
    return Record(None if page is None else int(page), named["WARC-Type"], urn("WARC-Record-ID"), named.get("WARC-Target-URI"), payload, length, digest, urn("WARC-Refers-To"), named.get("WARC-Refers-To-Target-URI"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Archive:
    """An archive being written; offsets are those of gzip members."""

    def __init__(self, store: fs.FileSystem, root: str) -> None:
        self.name, self.size = f"{uuid.uuid4().hex}.warc.gz", 0
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)

    def add(self, record: bytes) -> tuple[int, int]:
        member = gzip.compress(record, LEVEL, mtime=0)
        self.out.write(member)
        at, self.size = self.size, self.size + len(member)
        return at, len(member)


CAPTURE = "key string, record_id string, page_id long, kind string, file string, at long, length long"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, first_page, first_url, twin): twin where another page's equal payload is the response."""
    payload = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    twins = common.written(large.groupBy("digest").agg(least.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")), "warc-twins")
    few = twins.count() <= SMALL_ROWS
    joined = rows.join(F.broadcast(twins) if few else twins, "digest", "left")
    twin = (F.octet_length("payload") >= REVISIT_BYTES) & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.withColumn("twin", twin)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages; the captures table (``CAPTURE``), in the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        archive = None
        for batch in common.slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for page, url, payload, digest, first, first_url, twin in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if archive is None or archive.size > ARCHIVE_BYTES:
                    if archive:
                        archive.out.close()
                    archive = _Archive(store, root)
                refers = (record_id(first, digest), first_url, first) if twin else None
                at, length = archive.add(encode_record(page, url, payload, digest, refers))
                for col, value in zip(cols, (url_key(None if url is None else _clean(url)), record_id(page, digest), page, "revisit" if twin else "response", archive.name, at, length), strict=True):
                    col.append(value)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "record_id", "page_id", "kind", "file", "at", "length"])
        if archive:
            archive.out.close()

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "first_page", "first_url", "twin")
    return common.written(rows.mapInArrow(work, CAPTURE), "warc-captures")


@dataclass
class CaptureIndex:
    """The top level: shards (file, first key, first record id, where its directory is), in key order."""

    folder: str
    shards: list[tuple[str, str, str, int, int]]


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, at, directory, lines = None, f"{uuid.uuid4().hex}.cdxz", 0, [], []

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            out.write(block)
            directory.append([lines[0][0], lines[0][1], at, len(block)])
            at, lines = at + len(block), []

        for batch in common.slices(batches):
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(list(line))
                if len(lines) == block_lines:
                    flush()
        if out:
            if lines:
                flush()
            block = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(block)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]]), pa.array([at]), pa.array([len(block)])], ["file", "key", "record_id", "at", "length"])

    order = captures.repartitionByRange("key", "record_id").sortWithinPartitions("key", "record_id")
    made = common.written(order.mapInArrow(work, "file string, key string, record_id string, at long, length long"), "warc-shards").collect()
    return CaptureIndex(folder, sorted((tuple(r) for r in made), key=lambda r: (r[1], r[2])))


class _Reader:
    """Look-ups of one task; keeps a few directories and blocks."""

    def __init__(self, index: CaptureIndex, keep: int = 8) -> None:
        self.index, self.keep = index, keep
        self.store, self.root = _store(index.folder)
        self.firsts = [(s[1], s[2]) for s in index.shards]
        self.cache: OrderedDict[tuple[str, int], list] = OrderedDict()

    def range(self, file: str, at: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.root}/{file}") as f:
            return f.read_at(length, at)

    def inflated(self, file: str, at: int, length: int, lines: bool) -> list:
        if (file, at) not in self.cache:
            text = zlib.decompress(self.range(file, at, length)).decode()
            self.cache[file, at] = [json.loads(x) for x in text.split("\n")] if lines else json.loads(text)
            if len(self.cache) > self.keep:
                self.cache.popitem(last=False)
        self.cache.move_to_end((file, at))
        return self.cache[file, at]

    def captures(self, key: str, record: str | None) -> Iterator[list]:
        """Captures of a key, or the one with that record id."""
        low, high = (key, record or ""), (key, record or "\U0010ffff")
        for s in range(max(0, bisect.bisect_left(self.firsts, low) - 1), len(self.firsts)):
            if self.firsts[s] > high:
                return
            file, _, _, at, length = self.index.shards[s]
            blocks = self.inflated(file, at, length, False)
            starts = [(b[0], b[1]) for b in blocks]
            for b in range(max(0, bisect.bisect_left(starts, low) - 1), len(starts)):
                if starts[b] > high:
                    break
                lines = self.inflated(file, blocks[b][2], blocks[b][3], True)
                for line in lines[bisect.bisect_left(lines, [key, record or ""], key=lambda x: x[:2]) :]:
                    if (line[0], line[1]) > high:
                        break
                    yield line

    def record(self, capture: list) -> Record:
        return decode_record(zlib.decompress(self.range(*capture[4:7]), 31))


RECORD = "asked_url string, asked_id string, page_id long, kind string, payload_bytes long, digest string, payload binary"


def look_up(asked: DataFrame, index: CaptureIndex, with_payload: bool = True) -> DataFrame:
    """Records (``RECORD``) of each row (url, record_id or null) of ``asked``, by the index."""
    given: Broadcast = common.session(asked).sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in common.slices(batches):
            reader = reader or _Reader(given.value)
            out: list[tuple] = []
            wanted = sorted(zip(map(url_key, batch.column(0).to_pylist()), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda x: (x[0], x[2] or ""))
            for key, url, record in wanted:
                for capture in reader.captures(key, record):
                    r = reader.record(capture)
                    out.append((url, record, r.page_id, r.kind, r.payload_bytes, r.digest, r.payload if with_payload else None))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in RECORD.split(", ")])

    return asked.select(asked["url"].alias("url"), asked["record_id"].alias("record_id")).mapInArrow(work, RECORD)


def members(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Each gzip member of a file, inflated; the file is read in chunks."""
    with store.open_input_stream(path, compression=None) as f:
        inflate, parts, rest = zlib.decompressobj(31), [], b""
        while chunk := rest or f.read(CHUNK):
            parts.append(inflate.decompress(chunk))
            rest = b""
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, rest = zlib.decompressobj(31), [], inflate.unused_data


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that ``captures`` names: page_id, kind, payload_bytes, digest, refers_id, refers_url."""
    names = "page_id long, kind string, payload_bytes long, digest string, refers_id string, refers_url string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in names.split(", ")])

        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for raw in members(store, f"{root}/{file}"):
                    r = decode_record(raw)
                    rows.append((r.page_id, r.kind, r.payload_bytes, r.digest, r.refers_id, r.refers_url))
                    if len(rows) == 4096:
                        yield out(rows)
                        rows = []
                yield out(rows)

    files = captures.select("file").distinct()
    # a number of tasks of its own: names are few bytes, archives are not
    return files.repartition(max(1, min(files.count(), MOST_READERS)), "file").mapInArrow(work, names)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes, indexes and reads back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per page."""
    captures = write_archives(pages, folder)
    index = build_index(captures, folder)
    records = common.written(read_archives(captures, folder), "warc-records")
    revisits = records.where("kind = 'revisit'")
    asked = revisits.select(F.col("refers_url").alias("url"), F.col("refers_id").alias("record_id")).distinct()
    found = look_up(asked, index, False).where("kind = 'response'")
    targets = common.written(found.select("asked_id", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest")).distinct(), "warc-targets")
    few = targets.count() <= SMALL_ROWS
    resolved = revisits.join(F.broadcast(targets) if few else targets, revisits["refers_id"] == targets["asked_id"], "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    whole = records.where("kind = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return whole.unionByName(resolved)
