"""Readers and writers of the reference's own formats, over Spark's binaryFile and text sources.

A binary index is a 16-byte header (magic, record bytes, zero, record count, zero) and fixed 48-byte records,
little-endian. Bad files fail the task (``failfast``) or give one row with an error (``permissive``)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
RECORD_BYTES = 48
HEADER_BYTES = 16
MAGIC = bytes([0x41, 0x56, 0x4C, 0x49])
SAFE = 9007199254740991
_RECORD = struct.Struct("<QIIQQI12x")
_HEADER = struct.Struct("<4sHHII")

CHUNKS = "path string, ordinal long, byte_offset long, byte_length long, displayed_frames long, timestamp long, duration long, random_access boolean, error string"


class FormatError(ValueError):
    pass


def encode_index(records: list[tuple[int, int, int, int, int, bool]]) -> bytes:
    """Records: offset, length, displayed frames, timestamp, duration, random access."""
    body = b"".join(_RECORD.pack(o, n, f, t, d, int(r)) for o, n, f, t, d, r in records)
    out = _HEADER.pack(MAGIC, RECORD_BYTES, 0, len(records), 0) + body
    if decode_index(out) != [tuple(r) for r in records]:
        raise FormatError("records do not survive the round trip")
    return out


def decode_index(data: bytes) -> list[tuple[int, int, int, int, int, bool]]:
    if len(data) < HEADER_BYTES:
        raise FormatError("index is shorter than its header")
    magic, size, zero, count, reserved = _HEADER.unpack_from(data)
    if magic != MAGIC or size != RECORD_BYTES or zero or reserved:
        raise FormatError("index header is not of this format")
    if len(data) != HEADER_BYTES + count * RECORD_BYTES:
        raise FormatError("index length does not match its count")
    out = []
    for at in range(HEADER_BYTES, len(data), RECORD_BYTES):
        o, n, f, t, d, flags = _RECORD.unpack_from(data, at)
        if flags > 1 or any(data[at + 36 : at + RECORD_BYTES]):
            raise FormatError("reserved bits of a record are set")
        if max(o, t, d) > SAFE:
            raise FormatError("a record's integer is not safe")
        out.append((o, n, f, t, d, bool(flags)))
    return out


def read_indexes(spark: SparkSession, path: str, failfast: bool = True, most_bytes: int = 1 << 30) -> DataFrame:
    """One row per record of each index file."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, k, *r, None) for k, r in enumerate(decode_index(data))]
                except FormatError as x:
                    if failfast:
                        raise
                    rows.append((name, *[None] * 7, str(x)))
            kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in CHUNKS.split(", ")])

    return files.mapInArrow(work, CHUNKS)


# --- canonical JSON


def _strict_pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise FormatError("duplicate key")
    if {"__proto__", "constructor", "prototype"} & out.keys():
        raise FormatError("dangerous key")
    return out


def _safe_int(text: str) -> int:
    if abs(int(text)) > SAFE:
        raise FormatError("integer is not safe")
    return int(text)


def parse_json(data: bytes) -> object:
    """Strict JSON: no byte-order mark, duplicate or dangerous key, unsafe integer or non-finite number."""

    def refuse(text: str) -> None:
        raise FormatError(f"{text} is not a JSON number")

    if data.startswith(b"\xef\xbb\xbf"):
        raise FormatError("byte-order mark")
    try:
        return json.loads(data.decode("utf-8"), object_pairs_hook=_strict_pairs, parse_int=_safe_int, parse_constant=refuse)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as x:
        raise FormatError(str(x)) from x


def canonical_json(value: object) -> bytes:
    """Keys in UTF-8 byte order, no blanks, shortest numbers."""

    def order(v: object) -> object:
        if isinstance(v, dict):
            return {k: order(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-8"))}
        if isinstance(v, list):
            return [order(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) <= SAFE else v

    return json.dumps(order(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode("utf-8")


def parse_canonical(data: bytes) -> object:
    value = parse_json(data)
    if canonical_json(value) != data:
        raise FormatError("JSON is not canonical")
    return value


def canonical_column(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep..., canonical, was_canonical, error) of a JSON text column."""
    base = df.select(*keep, F.col(column).cast("string").alias("_json"))
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(n).to_pylist():
                try:
                    data = (text or "").encode()
                    canon = canonical_json(parse_json(data))
                    out.append((canon.decode(), canon == data, None))
                except FormatError as x:
                    out.append((None, False, str(x)))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], [*keep, "canonical", "was_canonical", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n])
    return base.mapInArrow(work, f"{schema}, canonical string, was_canonical boolean, error string")


# --- text


def read_samples(spark: SparkSession, path: str, schema: str, nullable: set[str]) -> DataFrame:
    """Strict CSV: the header must be the schema's names; integers and booleans in canonical form; other rows fail."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).options(header=True, enforceSchema=False, mode="FAILFAST", emptyValue="").csv(path)
    cols = []
    for name, kind in (c.split() for c in schema.split(", ")):
        c = F.col(name)
        ok = c.rlike("^(true|false)$") if kind == "boolean" else c.rlike("^(0|[1-9][0-9]{0,15})$")
        blank = c.isNull() | (c == "")
        allowed = (blank | ok) if name in nullable else (~blank & ok)
        cols.append(F.when(allowed, F.when(blank, None).otherwise(c).cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not canonical: "), F.coalesce(c, F.lit("null")))).cast(kind)).alias(name))
    return raw.select(*cols)


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Compact probe text, a line ``section|key=value|...`` each: (path, section, fields map)."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    section = F.substring_index("value", "|", 1)
    rest = F.expr("substring(value, length(substring_index(value, '|', 1)) + 2)")
    return line.where("value <> ''").select("path", section.alias("section"), F.str_to_map(rest, F.lit(r"\|"), F.lit("=")).alias("fields"))


def numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """A numbered picture sequence: (prefix, first, last, files, contiguous)."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*?)(\d+)(\.[a-z]+)$", 1).alias("prefix"), F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("number"))
    n = F.count(F.lit(1))
    return files.groupBy("prefix").agg(F.min("number").alias("first"), F.max("number").alias("last"), n.alias("files"), (F.max("number") - F.min("number") + 1 == n).alias("contiguous"))


def demux_ivf(data: bytes) -> list[tuple[int, bytes]]:
    """(timestamp, payload) of each frame of an IVF file."""
    if data[:4] != b"DKIF" or len(data) < 32:
        raise FormatError("not an IVF file")
    at, out = struct.unpack_from("<H", data, 6)[0], []
    while at < len(data):
        if at + 12 > len(data):
            raise FormatError("truncated frame header")
        size, stamp = struct.unpack_from("<IQ", data, at)
        if at + 12 + size > len(data):
            raise FormatError("truncated frame")
        out.append((stamp, data[at + 12 : at + 12 + size]))
        at += 12 + size
    return out


def verified(df: DataFrame, content: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose SHA-256 is as stated, and the others."""
    same = F.sha2(F.col(content).cast("binary"), 256) == F.col(digest)
    return df.where(same), df.where(~same | same.isNull())


# --- closed schemas and fixed points

#: Kinds of a closed schema: a dict of name -> kind (a trailing ? marks an optional name), [kind] for lists, or a type.
Kind = dict | list | type


def require(value: object, kind: Kind, at: str = "$") -> object:
    """Checks a parsed JSON value against a closed schema: no unknown key, no missing key, no other type."""
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            raise FormatError(f"{at} is not an object")
        names = {k.rstrip("?"): v for k, v in kind.items()}
        if extra := value.keys() - names.keys():
            raise FormatError(f"{at} has unknown keys {sorted(extra)}")
        for k, v in kind.items():
            name = k.rstrip("?")
            if name in value:
                require(value[name], v, f"{at}.{name}")
            elif not k.endswith("?"):
                raise FormatError(f"{at}.{name} is missing")
    elif isinstance(kind, list):
        if not isinstance(value, list):
            raise FormatError(f"{at} is not a list")
        for k, x in enumerate(value):
            require(x, kind[0], f"{at}[{k}]")
    elif not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
        raise FormatError(f"{at} is not of the type {kind.__name__}")
    return value


def stable(value: object, encode, advance, most: int) -> tuple[object, bytes]:
    """Repeats ``advance(value, bytes)`` until the bytes no longer change; an error after ``most`` rounds."""
    data = encode(value)
    for _ in range(most):
        value = advance(value, data)
        again = encode(value)
        if again == data:
            return value, data
        data = again
    raise FormatError(f"not stable after {most} rounds")


def read_documents(spark: SparkSession, path: str, schema: Kind, most_bytes: int = 1 << 20) -> DataFrame:
    """Strict JSON documents (projects, reports), a file each: (path, canonical, error)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for length, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    if length > most_bytes:
                        raise FormatError("document is too long")
                    out.append((canonical_json(require(parse_json(data), schema)).decode(), None))
                except FormatError as x:
                    out.append((None, str(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], pa.string()) for k in range(2)]], ["path", "canonical", "error"])

    return files.mapInArrow(work, "path string, canonical string, error string")
