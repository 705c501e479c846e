"""Packing: bounded-space online packing of token ids into windows.

Each partition keeps ``OPEN`` windows. A document goes best-fit into the fullest window that still
takes it whole; where none does, its head fills the fullest window, which is emitted, and the
rest is placed again. What is left open at the end of the partitions is merged: leftover windows
are dealt to few tasks, which fill windows one after another; the last, partly filled window of such
a task is cut into sequences whose lengths are powers of two, which need no padding.

White-space-separated chunks are tokenised apart and remembered (the tokenizer's pattern never spans
white space), two generations of ``MEMO`` at most in a worker, none of over ``LONG`` bytes.

Defined cases: null or empty text is the end id alone; a null doc_id stays null; repeated rows
are packed as often as they occur; no rows give no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
OPEN = 32
END_ID = 2
MEMO = 300_000
#: Longer chunks (text without spaces, encoded data) hardly repeat and would make the memory as large as the text.
LONG = 64
MERGE_WINDOWS = 256

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"


#: What a tokenizer file must say for its texts to be split here. Fixed values of that file format.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_here(said: dict) -> bool:
    """Whether the file's normaliser and splitting are the ones that ``ChunkTokenizer`` does itself."""
    splits = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (
        (said.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and [p.get("type") for p in splits] == ["Split", "ByteLevel"]
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
        and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"] or said.get("truncation"))
    )


class ChunkTokenizer:
    """Ids (unsigned 32-bit, little-endian bytes) of whole texts, by chunks between ASCII blanks.

    A tokenizer with ``NORMALIZERS`` and the split ``PATTERN`` is slow on text whose words it has not met, so chunks are
    split here and only the pieces go to its model. Texts with its special strings, and
    chunks with a letter whose lower case depends on context, go through it whole; so do all texts
    where the file says anything else than these two."""

    def __init__(self, source: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(source), memo
        self.by_chunks = _splits_here(json.loads(source))
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\s]+", re.ASCII)
        self.any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(plain)]
        self.alphabet = {**{x: chr(x) for x in plain}, **{x: chr(256 + k) for k, x in enumerate(rest)}}
        self.control = re.compile(rb"[\x00-\x1f\x7f]")
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(16)]
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk whose ASCII letters are lower case."""
        if chunk.isalpha():  # ASCII letters alone
            return self._piece(chunk.decode())
        if chunk[-1:] in b".,;:!?" and chunk[:-1].isalpha():
            return self.ids(chunk[:-1]) + self.ids(chunk[-1:])
        if chunk.isascii():
            pieces = self.ascii.findall(chunk.decode())
            if self.control.search(chunk):
                pieces = ["".join(self.alphabet[ord(c)] for c in p) for p in pieces]
        else:
            text = unicodedata.normalize("NFC", chunk.decode("utf-8", "replace"))
            if "\u03a3" in text or "\u0130" in text:
                return self._whole(text)
            pieces = ["".join(map(self.alphabet.__getitem__, p.encode())) for p in self.any.findall(text.lower())]
        return b"".join(map(self._piece, pieces))

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, "<u4").tobytes()

    def ids(self, chunk: bytes) -> bytes:
        """Two generations of remembered chunks, none of them long, bound the memory."""
        if len(chunk) > LONG:
            return self._chunk(chunk)
        found = self.young.get(chunk)
        if found is not None:
            return found
        found = self.old.get(chunk)
        if found is None:
            found = self._chunk(chunk)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[chunk] = found
        return found

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunks or (self.mark in text and any(s in text for s in self.special)):
            return self._whole(text.decode("utf-8", "replace"))
        words = text.lower().split()
        out = list(map(self.young.get, words))
        if None in out:
            out = [self.ids(w) if found is None else found for w, found in zip(words, out, strict=True)]
        return b"".join(out)


_encoders: dict[int, ChunkTokenizer] = {}


def _encoder(source: str, memo: int) -> ChunkTokenizer:
    """One for each worker process, which Spark reuses from task to task."""
    key = zlib.crc32(source.encode())
    if key not in _encoders or _encoders[key].most != memo:
        _encoders.clear()
        _encoders[key] = ChunkTokenizer(source, memo)
    return _encoders[key]


class Windows:
    """Open windows of one partition; pieces are (source row, start, ids)."""

    def __init__(self, first_id: int, size: int, keep: int) -> None:
        self.next, self.size, self.keep = first_id, size, keep
        self.open: list[list] = []  # [fill, pieces]

    def place(self, row, ids: bytes, start: int = 0) -> Iterator[tuple]:
        at, total = 0, len(ids) // 4
        while at < total:
            n = total - at
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.keep and n <= self.size:
                best = [0, []]
                self.open.append(best)
            elif self.open:
                best, n = max(self.open, key=lambda w: w[0]), 0
            else:
                best = [0, []]
                self.open.append(best)
                n = self.size
            n = min(n or self.size, self.size - best[0], total - at)
            best[1].append((row, start + at, ids[4 * at : 4 * (at + n)]))
            best[0] += n
            at += n
            if best[0] == self.size:
                self.open = [w for w in self.open if w is not best]
                yield from self.numbered(best[1])

    def numbered(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for row, start, ids in pieces:
            yield row, start, ids, self.next, offset
            offset += len(ids) // 4
        self.next += 1


def powers_of_two(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Cuts one window's pieces into runs whose lengths are falling powers of two."""
    total = sum(len(ids) // 4 for _, _, ids in pieces)
    rest = list(pieces)
    while total:
        need = 1 << (total.bit_length() - 1)
        total -= need
        run = []
        while need:
            row, start, ids = rest.pop(0)
            n = min(need, len(ids) // 4)
            run.append((row, start, ids[: 4 * n]))
            if 4 * n < len(ids):
                rest.insert(0, (row, start + n, ids[4 * n :]))
            need -= n
        yield run


def _rows(pieces: list[tuple], open_: bool, with_ids: bool) -> pa.RecordBatch:
    """``pieces``: ((doc_id, doc_tokens), start, ids, sequence, offset)."""
    col = lambda f, t: pa.array([f(p) for p in pieces], t)
    return pa.RecordBatch.from_arrays(
        [
            col(lambda p: p[0][0], pa.int64()), col(lambda p: p[1], pa.int64()), col(lambda p: len(p[2]) // 4, pa.int64()),
            col(lambda p: zlib.crc32(p[2]), pa.int64()), col(lambda p: p[0][1], pa.int64()), col(lambda p: p[3], pa.int64()), col(lambda p: p[4], pa.int64()), pa.array([open_] * len(pieces), pa.bool_()),
            col(lambda p: p[2] if with_ids or open_ else None, pa.binary()),
        ],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"],
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, keep_open: int = OPEN, end_id: int = END_ID, with_ids: bool = True, memo: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless ``with_ids``)."""
    spark = common.session(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, memo)
        windows = Windows(TaskContext.get().partitionId() << 32, window, keep_open)
        for batch in common.slices(batches, 128):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                ids = encoder.encode(text) + end
                out += windows.place((doc, len(ids) // 4), ids)
            yield _rows(out, False, with_ids)
        for _, pieces in windows.open:
            yield _rows(list(windows.numbered(pieces)), True, True)

    schema = PIECE
    first = common.written(base.mapInArrow(work, schema), "packing")
    left = first.where("open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (MERGE_WINDOWS * window)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows((1 << 62) | (TaskContext.get().partitionId() << 32), window, 1)
        for batch in common.slices(batches):
            out = []
            for doc, start, n, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 8)), strict=True):
                out += windows.place((doc, n), ids, start)
            yield _rows(out, False, with_ids)
        for _, pieces in windows.open:
            for run in powers_of_two(pieces):
                yield _rows(list(windows.numbered(run)), False, with_ids)

    dealt = left.repartition(int(tasks), "sequence_id").sortWithinPartitions("sequence_id", "offset")
    return first.where("NOT open").unionByName(dealt.mapInArrow(merge, schema)).drop("open")
