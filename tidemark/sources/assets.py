"""Asset files: a 64-byte header, a canonical JSON manifest, a chunk index and unit blobs, each at a multiple of 8.

The manifest's ``units`` (id, chunks) say how many chunks each blob has; blobs follow each other in that
order and chunks lie in a blob without gaps. A metadata scan reads header, manifest and index by range, never the payload."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import FormatError, canonical_json, decode_index, encode_index, parse_canonical

#: Fixed values of the format.
MAGIC = bytes([0x41, 0x56, 0x4C, 0x46, 0x0D, 0x0A, 0x1A, 0x0A])
MAJOR, MINOR = 1, 0
HEADER_BYTES = 64
MANIFEST_BYTES = 1024 * 1024
_HEADER = struct.Struct("<8sHHIIIQQQQQ")

CHUNK_ROWS = "path string, unit string, ordinal long, byte_offset long, byte_length long, displayed_frames long, timestamp long, duration long, random_access boolean, sha256 string"


def _up8(n: int) -> int:
    return -(-n // 8) * 8


@dataclass(frozen=True)
class Header:
    file_bytes: int
    manifest_bytes: int
    index_at: int
    index_bytes: int


def encode_header(h: Header) -> bytes:
    data = _HEADER.pack(MAGIC, MAJOR, MINOR, HEADER_BYTES, 0, 0, h.file_bytes, HEADER_BYTES, h.manifest_bytes, h.index_at, h.index_bytes)
    decode_header(data)
    return data


def decode_header(data: bytes) -> Header:
    if len(data) < HEADER_BYTES:
        raise FormatError("file is shorter than its header")
    magic, major, minor, size, flags, zero, file_bytes, manifest_at, manifest_bytes, index_at, index_bytes = _HEADER.unpack_from(data)
    if magic != MAGIC or zero or flags or size != HEADER_BYTES or manifest_at != HEADER_BYTES:
        raise FormatError("header is not of this format")
    if (major, minor) != (MAJOR, MINOR):
        raise FormatError(f"version {major}.{minor} is not supported")
    if not 0 < manifest_bytes <= MANIFEST_BYTES or index_at != _up8(HEADER_BYTES + manifest_bytes) or index_at + index_bytes > file_bytes:
        raise FormatError("header ranges do not fit")
    return Header(file_bytes, manifest_bytes, index_at, index_bytes)


def write_asset(manifest: dict, chunks: dict[str, list[tuple[bytes, int, int, int, bool]]]) -> bytes:
    """Canonical bytes. ``chunks``: per unit (payload, displayed frames, timestamp, duration, random access)."""
    units = [{"id": u, "chunks": len(chunks[u])} for u in sorted(chunks, key=lambda u: u.encode())]
    text = canonical_json(manifest | {"units": units})
    index_at = _up8(HEADER_BYTES + len(text))
    index_bytes = 16 + 48 * sum(u["chunks"] for u in units)
    at, records, body = _up8(index_at + index_bytes), [], b""
    for u in units:
        at, body = _up8(at), body + bytes(_up8(at) - at)
        for payload, frames, stamp, duration, key in chunks[u["id"]]:
            records.append((at, len(payload), frames, stamp, duration, key))
            at, body = at + len(payload), body + payload
    head = encode_header(Header(at, len(text), index_at, index_bytes))
    front = (head + text).ljust(index_at, b"\0") + encode_index(records)
    data = front.ljust(_up8(len(front)), b"\0") + body
    validate(data)
    return data


def front_index(data: bytes) -> tuple[Header, dict, list[tuple]]:
    """Header, manifest and records from a prefix that holds them; the payload may be missing."""
    h = decode_header(data)
    if len(data) < h.index_at + h.index_bytes:
        raise FormatError("prefix ends before the index does")
    text = data[HEADER_BYTES : HEADER_BYTES + h.manifest_bytes]
    if any(data[HEADER_BYTES + h.manifest_bytes : h.index_at]):
        raise FormatError("padding is not zero")
    manifest, records = parse_canonical(text), decode_index(data[h.index_at : h.index_at + h.index_bytes])
    if sum(u["chunks"] for u in manifest["units"]) != len(records):
        raise FormatError("index and manifest count different chunks")
    at, k = _up8(h.index_at + h.index_bytes), 0
    for u in manifest["units"]:
        at = _up8(at)
        for n, (offset, length, *_, key) in enumerate(records[k : k + u["chunks"]]):
            if offset != at or (n == 0 and not key):
                raise FormatError(f"unit {u['id']} is not laid out canonically")
            at += length
        k += u["chunks"]
    if at != h.file_bytes:
        raise FormatError("the last chunk does not end the file")
    return h, manifest, records


def validate(data: bytes) -> None:
    """The whole file: the front, the length and zero padding between blobs."""
    h, _, records = front_index(data)
    if len(data) != h.file_bytes:
        raise FormatError("file length is not the declared one")
    at = h.index_at + h.index_bytes
    for offset, length, *_ in records:
        if any(data[at:offset]):
            raise FormatError("padding is not zero")
        at = offset + length


def read_assets(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """One row per chunk of each asset (``CHUNK_ROWS``). Payload is read, and hashed, only with ``digests``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as f:
                    h = decode_header(f.read_at(HEADER_BYTES, 0))
                    _, manifest, records = front_index(f.read_at(h.index_at + h.index_bytes, 0))
                    units = [u["id"] for u in manifest["units"] for _ in range(u["chunks"])]
                    for k, (unit, r) in enumerate(zip(units, records, strict=True)):
                        rows.append((name, unit, k, *r, hashlib.sha256(f.read_at(r[1], r[0])).hexdigest() if digests else None))
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in CHUNK_ROWS.split(", ")])

    return files.mapInArrow(work, CHUNK_ROWS)
