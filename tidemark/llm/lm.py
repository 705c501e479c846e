"""Brown class-based bigram language model.

p(text) = product over tokens of p(class | class before) * p(word | class). Tokens: lower-cased (A-Z) words
``[^\\x20\\x09-\\x0D]+`` and one end token, which is a class of its own and stands before the first word too.

Classes. The ``CORE`` most frequent words start by exchange clustering in the driver: each word in turn moves
to the class where the class bigrams' likelihood is largest, until nothing moves. Their classes and the shapes of
all other words are the contexts in which every word of the training part is then counted, in a table with a
row a word. Distributed sweeps over that table move each word that occurs ``LEAST`` times or more, those of the
core too, to the class whose contexts make its own likeliest, and take the classes' contexts anew, until hardly
anything is gained. So the clustered words grow with the vocabulary; which class a word beyond the broadcast
ones has is looked up in a join. In both tables, and where contexts are counted, a word is its 64-bit hash. Words seen once stand for what was never seen: they share shape classes (ASCII or not, kind
of the last byte) with it.

Smoothing. p(c | b) is Witten-Bell: (n(b, c) + T * p(c)) / (n(b) + T), T the number of classes, and
p(c) is add-one. p(w | c) is absolute discounting by ``DISCOUNT``; what is taken off goes to the one event
"word never seen", as the base score's extra place in V + 1 does. A class without any
training word gives that event probability one.

The vocabulary is unbounded, so only the ``HEAD`` most frequent words' counts are broadcast. For all
others a document sends its word hashes to the table of words in a join and gets counts and classes back.

Defined cases: null or empty text is the end token alone; a null doc_id is never learnt from and
counts as held out; repeated rows are scored and learnt from as often as they occur; without
training rows every class event is uniform; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CORE = 512
LEAST = 2
CLASSES = 48
HEAD = 100_000
DISCOUNT = 0.7
SWEEPS = 20
#: The distributed sweeps end once one gains less than this share of the log-likelihood.
GAIN = 0.002
FLUSH = 400_000
#: Rows of a batch that goes from Python to the JVM, which holds it outside its heap.
SENT = 20_000
SHAPES = 8
#: ``shape`` of an ASCII word by its last byte, and of other words less 4.
ENDS = np.array([0 if 97 <= b <= 122 or b >= 128 else 1 if b == 46 else 2 if b == 44 else 3 for b in range(256)], np.int64)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
NO_SPACE = np.array([len(bytes([b]).split()) == 1 for b in range(256)])
#: How often a word stands in a context: within a task, and over the whole table.
CELL = np.dtype([("code", "<u2"), ("n", "<u4")])
SUM = np.dtype([("code", "<u2"), ("n", "<i8")])


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shape(word: bytes) -> int:
    """Shape class of a word outside the clustered ones."""
    return int(ENDS[word[-1]]) + 4 * (not word.isascii())


def _shapes(words: list[bytes]) -> np.ndarray:
    """``shape`` of each word."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    if not len(ends):
        return np.zeros(0, np.int64)
    return ENDS[data[ends - 1]] + 4 * (np.maximum.reduceat(data, np.append(0, ends[:-1])) >= 128)


def _hashes(words: list[bytes]) -> np.ndarray:
    """The words' hashes as Spark has them."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The values' bytes, so many values an element."""
    offsets = pa.array(np.append(0, np.cumsum(lengths)) * values.itemsize, pa.int64()).cast(pa.int32())  # fails beyond 2 GB
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets.buffers()[1], pa.py_buffer(values.view(np.uint8))])


def _content(column: pa.Array, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """(number of values of each element, all values) of what ``_binaries`` made."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    held = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind)
    return np.diff(at) // held.itemsize, held


def _parsed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, hash and shape of each word), as ``tokens``, ``_hashes`` and ``shape`` give them."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    _, bounds, buffer = texts.buffers()
    at = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = LOWER[np.frombuffer(buffer or b"", np.uint8)[at[0] : at[-1]]]
    at = at.astype(np.int64) - at[0]
    inside = NO_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    some = at[:-1] < at[1:]
    begins[at[:-1][some]] |= inside[at[:-1][some]]
    ends[at[1:][some] - 1] |= inside[at[1:][some] - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(begins):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shapes = ENDS[data[ends - 1]] + 4 * (np.maximum.reduceat(data, begins) >= 128)
    return np.diff(np.searchsorted(begins, at)), _xxh64(data, begins, ends - begins), shapes


def _xxh64(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of many stretches of bytes, those of one length at a time; long ones go through the library."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    padded = np.append(data, np.zeros(8, np.uint8))
    eights, fours = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    out = np.empty(len(begins), np.uint64)
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint16), kind="stable")
    cuts = np.searchsorted(lengths[order], np.arange(1, 33))
    for n, begin, end in zip(range(1, 32), cuts[:-1], cuts[1:], strict=True):
        if begin == end:
            continue
        spot = begins[order[begin:end]]
        h = np.full(len(spot), 42 + int(five) + n, np.uint64)
        for k in range(0, n - 7, 8):
            h = turned(h ^ turned(eights[spot + k] * two, 31) * one, 27) * one + four
        k = n - n % 8
        if n - k >= 4:
            h = turned(h ^ fours[spot + k].astype(np.uint64) * one, 23) * two + three
            k += 4
        for k in range(k, n):
            h = turned(h ^ data[spot + k].astype(np.uint64) * five, 11) * one
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        out[order[begin:end]] = h ^ (h >> np.uint64(32))
    for k in order[cuts[-1] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[begins[k] : begins[k] + lengths[k]].tobytes(), 42)
    return out


def _found(h: np.ndarray, words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """For each hash the id of the word with it, or -1."""
    own = _hashes(words).view(np.uint64)
    order = np.argsort(own)
    own, ids = np.append(own[order], np.uint64(0)), np.append(ids[order], -1)
    # a first look at 16 bits of the hash leaves few to search for
    maybe = np.zeros(1 << 16, bool)
    maybe[own[:-1] & np.uint64(0xFFFF)] = True
    out, some = np.full(len(h), -1), np.flatnonzero(maybe[h & np.uint64(0xFFFF)])
    at = np.searchsorted(own[:-1], h[some])
    out[some] = np.where(own[at] == h[some], ids[at], -1)
    return out


def _between_ends(lengths: np.ndarray, values: np.ndarray, end: int) -> np.ndarray:
    """The values, of which each text has its number, with ``end`` after each text."""
    out = np.full(len(values) + len(lengths), end, values.dtype)
    word = np.ones(len(out), bool)
    word[np.cumsum(lengths + 1) - 1] = False
    out[word] = values
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long): every distinct word and its occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in common.slices(batches, 128):
            for text in common.as_bytes(batch.column(0)):
                seen.update(tokens(text))
            if len(seen) > FLUSH:
                yield from common.slices(iter([out()]), SENT)
                seen.clear()
        yield from common.slices(iter([out()]), SENT)

    return docs.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(docs: DataFrame, ids: dict[bytes, int]) -> np.ndarray:
    """Counts of (id before, id) over all adjacent tokens of all documents, the ends included.

    ``ids`` maps words; other words have the ids len(ids) + shape, the end has the last."""
    spark = common.session(docs)
    given, first = spark.sparkContext.broadcast(ids), len(ids)
    size = first + SHAPES + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = first + SHAPES
        sums = np.zeros(size * size, np.int64)
        words, numbers = list(given.value), np.array(list(given.value.values()), np.int64)
        for batch in common.slices(batches):
            lengths, h, shapes = _parsed(batch.column(0))
            k = _found(h, words, numbers)
            at = np.append(end, _between_ends(lengths, np.where(k < 0, first + shapes, k), end))
            sums += np.bincount(at[:-1] * size + at[1:], minlength=len(sums))
        got = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(sums[got])], ["cell", "n"])

    return _table(docs.select("text").mapInArrow(work, "cell long, n long"), size)


def _table(cells: DataFrame, size: int) -> np.ndarray:
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the first ``words`` ids; ids beyond them keep classes of their own after ``classes``.

    Maximises the class-bigram likelihood, sum of n(b,c) log n(b,c) less the marginals' sums."""
    extra = len(pairs) - words
    classes = max(1, min(classes, words))
    total = classes + extra
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(extra)]).astype(np.int64)
    pairs = pairs.astype(np.float64)
    onehot = np.zeros((len(pairs), total))
    onehot[np.arange(len(pairs)), of] = 1
    table = onehot.T @ pairs @ onehot
    right, left = pairs @ onehot, pairs.T @ onehot
    self_n = np.diag(pairs)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a = of[w]
            r, lt, own = right[w].copy(), left[w].copy(), self_n[w]
            r[a] -= own
            lt[a] -= own
            table[a, :] -= r
            table[:, a] -= lt
            table[a, a] -= own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            plus_r = _xlogx(table[:classes] + r[None, :]) - _xlogx(table[:classes])
            plus_l = _xlogx(table[:, :classes] + lt[:, None]) - _xlogx(table[:, :classes])
            k = np.arange(classes)
            both = table[k, k] + r[k] + lt[k] + own
            gain = plus_r.sum(axis=1) - plus_r[k, k] + plus_l.sum(axis=0) - plus_l[k, k] + _xlogx(both) - _xlogx(table[k, k])
            out_n, in_n = r.sum() + own, lt.sum() + own
            gain -= _xlogx(rows[:classes] + out_n) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + in_n) - _xlogx(cols[:classes])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b, :] += r
            table[:, b] += lt
            table[b, b] += own
            if b != a:
                of[w] = b
                moved += 1
                for counts, other in ((right, pairs[:, w]), (left, pairs[w])):
                    counts[:, a] -= other
                    counts[:, b] += other
        if not moved:
            break
    return of[:words]


def _contexts(train: DataFrame, core: dict[bytes, int], classes: int, only: set[bytes] | None, least: int) -> DataFrame:
    """(h long, n long, cells binary): how often each word stands before and after which context, as records of ``SUM``.

    Contexts: the core words' classes, other words' shapes, the end. Code c is 'before context c', ``size`` + c is
    'after context c'. Words with n < ``least`` have no cells; ``only`` leaves out all words but its own."""
    spark = common.session(train)
    given = spark.sparkContext.broadcast((core, None if only is None else _hashes(list(only)).view(np.uint64)))
    size = classes + SHAPES + 1
    wide = 2 * size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = given.value
        core, core_class = list(known), np.array(list(known.values()), np.int64)

        def out() -> pa.RecordBatch:
            shapes, lengths = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            h = np.concatenate([p[0] for p in parts])
            parts.clear()
            # as np.unique, but the places are numbered in as few bytes as they need; arrays go as soon as they are used
            order = np.argsort(h)
            h = h[order]
            first = _firsts(h)
            kind = np.int32 if (len(first) + 1) * wide < 1 << 31 else np.int64
            words, new, k = h[first], np.zeros(len(h), bool), np.empty(len(h), kind)
            new[first] = True
            k[order] = np.cumsum(new, dtype=kind)
            del h, order, new
            around = np.empty(len(words) + 1, kind)
            around[k] = classes + shapes.astype(kind)
            around[0] = size - 1
            c = _found(words, core, core_class)
            around[1:][c >= 0] = c[c >= 0]
            at = np.append(kind(0), _between_ends(lengths, k, 0))
            del k
            left, right = at[:-1], at[1:]
            keys = np.concatenate([(left * kind(wide) + around[right])[left > 0], (right * kind(wide) + (around + kind(size))[left])[right > 0]])
            del at, left, right
            keys.sort()
            first = _firsts(keys)
            keys, n = keys[first], np.diff(np.append(first, len(keys)))
            word, code = np.divmod(keys, kind(wide))
            if wanted is not None:
                keep = np.isin(words, wanted)[word - 1]
                word, code, n = word[keep], code[keep], n[keep]
            first = _firsts(word)
            return _celled(words[word[first] - 1].view(np.int64), np.diff(np.append(first, len(word))), code, n, CELL)

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in common.slices(batches):
            lengths, h, shapes = _parsed(batch.column(0))
            parts.append((h, shapes.astype(np.uint8), lengths))
            if sum(len(p[0]) for p in parts) > 8 * FLUSH:
                yield from common.slices(iter([out()]), SENT)
        if parts:
            yield from common.slices(iter([out()]), SENT)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 10_000:
                done, rest = _merged(held, size, least, False)
                yield done
                held, rows = [rest], 0
        if held:
            yield _merged(held, size, least, True)[0]

    made = train.select("text").mapInArrow(counted, "h long, cells binary")
    return common.written(made.repartition("h").sortWithinPartitions("h").mapInArrow(merge, "h long, n long, cells binary"), "lm-contexts")


def _celled(h: np.ndarray, lengths: np.ndarray, codes: np.ndarray, ns: np.ndarray, kind: np.dtype, n: np.ndarray | None = None) -> pa.RecordBatch:
    cells = np.empty(len(codes), kind)
    cells["code"], cells["n"] = codes, ns
    columns = {"h": pa.array(h, pa.int64()), **({} if n is None else {"n": pa.array(n, pa.int64())}), "cells": _binaries(cells, lengths)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all values)."""
    return column.value_lengths().fill_null(0).to_numpy(), column.flatten().to_numpy()


def _merged(held: list[pa.RecordBatch], size: int, least: int, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """Rows of one word, which lie together, as one; the last word's rows are given back unless ``last``."""
    table = pa.Table.from_batches(held).combine_chunks()
    batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], schema=table.schema)
    h = batch.column(0).to_numpy()
    rest = None
    if not last:
        end = int(np.flatnonzero(h == h[-1])[0])
        rest, batch, h = batch.slice(end), batch.slice(0, end), h[:end]
    first, wide = _firsts(h), 2 * size
    word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    lengths, cells = _content(batch.column(1), CELL)
    sums = np.bincount(np.repeat(word, lengths) * wide + cells["code"], cells["n"], len(first) * wide).astype(np.int64)
    n = sums.reshape(len(first), wide)[:, :size].sum(axis=1)
    keys = np.flatnonzero(sums)
    keys = keys[n[keys // wide] >= least]
    of, code = np.divmod(keys, wide)
    return _celled(h[first], np.bincount(of, minlength=len(first)), code, sums[keys], SUM, n), rest


def _nearest(batch: pa.RecordBatch, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row or -1, its log-likelihood; row, code and count of each cell)."""
    lengths, cells = _content(batch.column(2), SUM)
    codes, ns = cells["code"].astype(np.int64), cells["n"].astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    of, fit = np.full(len(lengths), -1), np.zeros(len(lengths))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        fits = np.add.reduceat(logs[codes] * ns[:, None], starts, axis=0)
        of[some], fit[some] = fits.argmax(axis=1), fits.max(axis=1)
    return of, fit, row, codes, ns


def _swept(contexts: DataFrame, sums: np.ndarray, sweeps: int = SWEEPS) -> DataFrame:
    """(h, n, class): each word's class after sweeps that begin with the classes' context counts ``sums`` (code, class)."""
    spark = common.session(contexts)
    wide, classes = sums.shape

    def logs_of(sums: np.ndarray):
        smooth = sums + 0.5
        sides = smooth.reshape(2, wide // 2, classes)
        return spark.sparkContext.broadcast(np.log(sides / sides.sum(axis=1, keepdims=True)).reshape(wide, classes))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of more rows, for fewer and larger steps of numpy."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if len(held) == 8:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    before = None
    for _ in range(sweeps):
        given = logs_of(sums)

        def work(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            logs, new, total = given.value, np.zeros(wide * classes), 0.0
            for batch in joined(batches):
                of, fit, row, codes, ns = _nearest(batch, logs)
                new += np.bincount(codes * classes + of[row], ns, minlength=len(new))
                total += float(fit.sum())
            got = np.flatnonzero(new)
            # the last cell is the log-likelihood
            yield pa.RecordBatch.from_arrays([pa.array(np.append(got, len(new))), pa.array(np.append(new[got], total))], ["cell", "n"])

        cells = contexts.where("octet_length(cells) > 0").mapInArrow(work, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        fresh = np.zeros(wide * classes + 1)
        fresh[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
        sums, fit = fresh[:-1].reshape(wide, classes), fresh[-1]
        if fit == 0 or (before is not None and fit - before < GAIN * abs(before)):
            break
        before = fit
    given = logs_of(sums)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            of = _nearest(batch, given.value)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, pa.int16())], ["h", "n", "class"])

    return common.written(contexts.mapInArrow(assign, "h long, n long, class short"), "lm-words")


@dataclass
class Model:
    """All of it is bounded: HEAD words' counts and classes, class tables. Further words are in the table of words."""

    ids: dict[bytes, int]
    class_of: np.ndarray
    head: dict[bytes, int]
    log_step: np.ndarray | None
    class_n: np.ndarray
    class_v: np.ndarray
    tokens: int
    types: int
    documents: int
    complete: bool

    def emission(self, c: int, n: int) -> float:
        total, types = self.class_n[c], self.class_v[c]
        if total == 0:
            return 0.0
        if c < len(self.class_n) - 1 - SHAPES:
            return float(np.log10(n / total))
        return float(np.log10((n - DISCOUNT if n else DISCOUNT * types) / total))

    def base(self, n: int) -> float:
        return float(np.log10((n + 1) / (self.tokens + self.types + 1)))


def clustered(train: DataFrame, core: int = CORE, classed: int | None = None, classes: int = CLASSES, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model without its class bigrams, and the table of words (h, n, class), where -1 is a shape class.

    ``classed`` clusters so many words instead of all that occur ``LEAST`` times."""
    counts = common.written(word_counts(train), "lm-counts")
    documents = train.count()
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    words, types = sums[0] or 0, sums[1]
    top = _most_frequent(counts, head)
    first = [w for w, n in top if n >= LEAST] if classed is None else [w for w, _ in top[:classed]]
    core = min(core, len(first))

    ids = {w: k for k, w in enumerate(first[:core])}
    pairs = _pairs(train, ids)
    core_class = exchange(pairs, core, classes)
    classes = max(1, int(core_class.max()) + 1) if core else 1
    size = classes + SHAPES + 1

    # context counts of the core's classes, on both sides
    own = np.concatenate([core_class, classes + np.arange(SHAPES + 1)]).astype(np.int64)
    fixed = np.zeros((size, size))
    np.add.at(fixed, (own[:, None].repeat(len(own), 1), own[None, :].repeat(len(own), 0)), pairs)
    start = np.concatenate([fixed[:classes].T, fixed[:, :classes]])
    only = None if classed is None else set(first)
    contexts = _contexts(train, dict(zip(first[:core], core_class.tolist(), strict=True)), classes, only, LEAST if classed is None else 1)
    table = _swept(contexts, start)
    common.removed(contexts)

    class_n, class_v = np.zeros(size), np.zeros(size)
    for c, n, v in table.where("class >= 0").groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
        class_n[c], class_v[c] = n, v
    tail = counts.where(F.col("n") < LEAST) if classed is None else _tail(counts, top, classed)
    for c, n, v in tail.groupBy(_shape_column(F.col("word")).alias("s")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        class_n[classes + c], class_v[classes + c] = n, v
    class_n[-1] = documents

    ids = {w: k for k, w in enumerate(first)}
    class_of = np.zeros(len(first), np.int64)
    if first:
        found = table.where(F.col("n") >= top[len(first) - 1][1]).toArrow()
        of = dict(zip(found.column(0).to_pylist(), found.column(2).to_pylist(), strict=True))
        class_of = np.array([of[h] for h in np.array([xxhash.xxh64_intdigest(w, 42) for w in first], np.uint64).view(np.int64).tolist()])
    if classed is not None:
        table = counts.select(F.xxhash64("word").alias("h"), "n", F.lit(-1).cast("short").alias("class"))
    return Model(ids, class_of, dict(top), None, class_n, class_v, words + documents, types + (documents > 0), documents, types <= len(top)), table


def learn(train: DataFrame, core: int = CORE, classed: int | None = None, classes: int = CLASSES, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model and the table of words it came from."""
    model, table = clustered(train, core, classed, classes, head)
    return _stepped(model, sequences(train.withColumn("_learn", F.lit(True)), model, table)), table


def learnt_and_scored(docs: DataFrame, learnt: Column) -> tuple[Model, DataFrame]:
    """The model of the rows where ``learnt`` is true, and ``score`` of all; the texts' classes are looked up once."""
    learnt = F.coalesce(learnt, F.lit(False))
    model, table = clustered(docs.where(learnt))
    rows = sequences(docs.withColumn("_learn", learnt), model, table)
    model = _stepped(model, rows)
    return model, _scored(rows, model)


def _stepped(model: Model, rows: DataFrame) -> Model:
    """The model with the class bigrams of ``sequences`` that are learnt from."""
    total = len(model.class_n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, np.int64)
        for batch in batches:
            at = _content(batch.column(0), np.uint16)[1].astype(np.int64)
            sums += np.bincount(at[:-1] * total + at[1:], minlength=len(sums))
            # between two rows two ends meet, which is no step
            sums[-1] -= max(0, batch.num_rows - 1)
        got = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(sums[got])], ["cell", "n"])

    steps = _table(rows.where("learnt").select("seq").mapInArrow(work, "cell long, n long"), total).astype(np.float64)
    class_n = steps.sum(axis=0)
    p = (class_n + 1) / (class_n.sum() + total)
    return replace(model, log_step=np.log10((steps + total * p[None, :]) / (steps.sum(axis=1, keepdims=True) + total)))


def _hash(word: bytes) -> int:
    """The word's hash as Spark has it; it orders words that are equally frequent."""
    return xxhash.xxh64_intdigest(word, 42) - (1 << 64 if xxhash.xxh64_intdigest(word, 42) >> 63 else 0)


def _rank(row: tuple[bytes, int]) -> tuple:
    return -row[1], _hash(row[0]), row[0]


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The first ``most`` words in the order (falling n, hash, word), all of them where there are fewer.

    The place of the cut comes from three small histograms, of log2(n) in 1/16 steps, of n within the step that holds the cut
    and of the hash among the words with the cut's n, so nothing is sorted across tasks and ties of any number are cut exactly."""
    sizes = lambda df, key: [tuple(r) for r in df.groupBy(key.alias("k")).count().collect()]
    step, h = F.floor(16 * F.log2("n")), F.xxhash64("word")
    part = F.shiftright(h, 48)
    taken, room, rest = [], most, F.lit(True)
    for key, falling in ((step, True), (F.col("n"), True), (part, False)):
        least = cut = None
        for at, n in sorted(sizes(counts.where(rest), key), reverse=falling):
            if n > room:
                cut = at
                break
            room, least = room - n, at
        if least is not None:
            taken.append(rest & ((key >= least) if falling else (key <= least)))
        if cut is None:
            break
        rest = rest & (key == cut)
    found = [] if not taken else _words(counts.where(reduce(Column.__or__, taken)))
    if cut is not None and room:
        found += sorted(_words(counts.where(rest)), key=_rank)[:room]
    return sorted(found, key=_rank)


def _words(counts: DataFrame) -> list[tuple[bytes, int]]:
    found = counts.select("word", "n").toArrow()
    return list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def _tail(counts: DataFrame, top: list, most: int) -> DataFrame:
    """Words after the first ``most`` in the order (falling n, hash, word)."""
    return counts.where(_after(top[min(most, len(top)) - 1])) if top and most else counts


def _after(row) -> Column:
    h, word = F.xxhash64("word"), F.col("word")
    later = (h > F.lit(_hash(row[0]))) | ((h == F.lit(_hash(row[0]))) & (word > F.lit(row[0])))
    return (F.col("n") < row[1]) | ((F.col("n") == row[1]) & later)


def _shape_column(word: Column) -> Column:
    """``shape`` in Spark's functions."""
    last = F.conv(F.hex(F.call_function("right", word.cast("string"), F.lit(1))), 16, 10)
    code = F.when(F.length(F.call_function("right", word.cast("string"), F.lit(1)).cast("binary")) > 1, 200).otherwise(last.cast("int"))
    end = F.when(code.between(97, 122) | (code >= 128), 0).when(code == 46, 1).when(code == 44, 2).otherwise(3)
    plain = F.octet_length(word) == F.char_length(word.cast("string"))
    return end + F.when(plain, 0).otherwise(4)


def sequences(docs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, base_score, emission, seq) for each row: ``seq`` has the tokens' classes
    as 16-bit numbers, an end before and after; ``emission`` is the sum of log p(word | class)."""
    spark = common.session(docs)
    given = spark.sparkContext.broadcast(model)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["_learn"].alias("learnt"), docs["text"].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        n_classes = len(own.class_n) - 1 - SHAPES
        end, first = n_classes + SHAPES, TaskContext.get().partitionId() << 40
        # class, base score and emission of the broadcast words, and a place for all others
        head = list(own.head)
        ns = np.array(list(own.head.values()), np.float64)
        at = np.fromiter(map(own.ids.get, head, repeat(-1)), np.int64, len(head))
        of = np.append(n_classes + _shapes(head), 0)
        of[:-1][at >= 0] = own.class_of[at[at >= 0]]
        plains = np.append(np.log10((ns + 1) / (own.tokens + own.types + 1)), own.base(0) if own.complete else 0.0)
        totals = np.append(np.log10(np.where(of[:-1] < n_classes, ns, ns - DISCOUNT) / own.class_n[of[:-1]]), 0.0)
        unseen = np.array([own.emission(n_classes + c, 0) for c in range(SHAPES)])
        get = dict(zip(head, range(len(head)), strict=True)).get
        for batch in common.slices(batches, 128):
            texts = [tokens(text) for text in common.as_bytes(batch.column(2))]
            rows, lengths = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            flat = list(chain.from_iterable(texts))
            k = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            row, missed = np.repeat(np.arange(rows), lengths), np.flatnonzero(k < 0)
            lost, place = [flat[j] for j in missed.tolist()], np.arange(len(flat)) + 2 * row + 1
            c, total = of[k], totals[k]
            c[missed] = n_classes + _shapes(lost)
            if own.complete:
                total[missed] = unseen[c[missed] - n_classes]
            seq = np.full(len(flat) + 2 * rows, end, np.uint16)
            seq[place] = c
            known = np.bincount(row[k >= 0], minlength=rows) + (1 if own.documents else 0)
            sums = [np.bincount(row, x, rows).astype(np.float64) for x in (plains[k], total)]
            # the places of words beyond the broadcast ones, by the numbers of their hashes within the row
            missed = missed[: 0 if own.complete else None]
            h, of_row = _hashes(lost[: len(missed)]), row[missed]
            order = np.lexsort((h, of_row))
            new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(of_row[order]) != 0))[: len(h)]
            words = np.bincount(of_row[order][new], minlength=rows)
            spots = np.empty((len(h), 2), np.int32)
            spots[:, 0] = place[missed] - (np.cumsum(lengths + 2) - lengths - 2)[of_row]
            spots[order, 1] = np.cumsum(new) - 1 - (np.cumsum(words) - words)[of_row[order]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(first, first + rows)),
                    batch.column(0),
                    batch.column(1),
                    pa.array(lengths + 1),
                    pa.array(known),
                    pa.array(sums[0] + own.base(own.documents)),
                    pa.array(sums[1]),
                    _binaries(seq, lengths + 2),
                    _binaries(spots.ravel(), 2 * np.bincount(of_row, minlength=rows)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words)), pa.int32()), pa.array(h[order][new], pa.int64())),
                ],
                ["row", "doc_id", "learnt", "n_tokens", "n_known", "base_score", "emission", "seq", "spots", "hashes"],
            )
            first += rows

    out = "doc_id long, learnt boolean, n_tokens long, n_known long, base_score double, emission double, seq binary"
    rows = common.written(base.mapInArrow(work, "row long, " + out + ", spots binary, hashes array<long>"), "lm-rows")
    if model.complete:
        return rows.drop("row", "spots", "hashes")
    asked = rows.where(F.size("hashes") > 0).select("row", F.posexplode("hashes").alias("j", "h"))
    found = asked.join(table, "h").groupBy("row").agg(F.collect_list(F.struct("j", "n", "class")).alias("found"))
    both = rows.drop("hashes").join(found, "row", "left").select("doc_id", "learnt", "n_tokens", "n_known", "base_score", "emission", "seq", "spots", "found.j", "found.n", "found.class")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        n_classes = len(own.class_n) - 1 - SHAPES
        log_total = np.log10(np.maximum(own.class_n, 1))
        unseen = np.array([own.emission(c, 0) if n_classes <= c < n_classes + SHAPES else 0.0 for c in range(len(own.class_n))])
        size = float(own.tokens + own.types + 1)
        for batch in common.slices(batches):
            lengths, seq = _content(batch.column(6), np.uint16)
            asked, spots = _content(batch.column(7), np.int32)
            spots, asked = spots.reshape(-1, 2), asked // 2
            row, seq = np.repeat(np.arange(len(asked)), asked), seq.copy()
            first = np.cumsum(asked) - asked
            n, of = np.zeros(len(spots), np.int64), np.full(len(spots), -1)
            answered, j = _flat(batch.column(8))
            at = np.repeat(first, answered) + j
            n[at], of[at] = _flat(batch.column(9))[1], _flat(batch.column(10))[1]
            at = first[row] + spots[:, 1]
            n, of = n[at], of[at]
            place = (np.cumsum(lengths) - lengths)[row] + spots[:, 0]
            seq[place[of >= 0]] = of[of >= 0]
            c = seq[place]
            known = np.log10(np.where(of >= 0, np.maximum(n, 1), np.maximum(n - DISCOUNT, 0.1))) - log_total[c]
            adds = n > 0, np.log10((n + 1) / size), np.where(n > 0, known, unseen[c])
            sums = [pa.array(batch.column(3 + k).to_numpy() + np.bincount(row, x, len(asked)).astype(kind)) for k, (x, kind) in enumerate(zip(adds, (np.int64, np.float64, np.float64), strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *sums, _binaries(seq, lengths)], ["doc_id", "learnt", "n_tokens", "n_known", "base_score", "emission", "seq"])

    filled = common.written(both.mapInArrow(fill, out), "lm-sequences")
    common.removed(rows)
    return filled


def score(docs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row."""
    return _scored(sequences(docs.withColumn("_learn", F.lit(False)), model, table), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    given = common.session(rows).sparkContext.broadcast(model.log_step)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, at = _content(batch.column(5), np.uint16)
            steps, ends = given.value[at[:-1], at[1:]], np.cumsum(lengths)
            steps[ends[:-1] - 1] = 0
            total = np.add.reduceat(steps, ends - lengths) if len(ends) else np.zeros(0)
            score = pa.array(total + batch.column(4).to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), score], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return rows.select("doc_id", "n_tokens", "n_known", "base_score", "emission", "seq").mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")
