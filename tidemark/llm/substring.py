"""Substring dedup by relative Lempel-Ziv parsing.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A document is parsed into factors that also occur elsewhere in the corpus
and literals between them. The reference is the whole corpus, and it would be hopeless to match every
document with all of it, so both are cut at anchors: of the ``GRAM``-word hashes in a window of ``WINDOW`` words the least
(leftmost) one is the window's anchor. Equal windows have equal anchors, so a window can only recur where its anchor does.

1. Anchors are counted; those that occur once hold no factor.
2. The reference: each distinct surrounding of a repeated anchor goes, with its words, to the reference block of its
   anchor. A block is indexed by the hashes of all its ``WINDOW``-word seeds, and every surrounding in it is parsed greedily
   against the index: from a seed that occurs at another place the factor goes on as long as the words of that source do;
   where it ends, the seeds that run over its end are looked up one by one, since they may have other sources. A
   hash only proposes; the words of the two places are compared. What comes out is, for each surrounding, which of its
   windows lie in factors.
3. Documents are parsed again: each of their anchors takes its surrounding's factors, whichever block it
   was in; factors from different blocks that meet or overlap are joined.

Counting is by occurrence (repeated documents are occurrences too). Surroundings repeated within a
chunk of documents are merged before they are shuffled. An anchor with more than ``HOT`` occurrences has no block, which one
task would have to hold: its windows are counted by Spark with map-side combining, by their 128-bit hashes, and what
they find is spread over ``SALTS`` tasks a window. The filters of repeated and of hot anchors that the tasks get have at most
2^``FILTER_BITS`` bits each; what they let pass wrongly is found not to match, or counted the other way with the same result.

Exact but for 128-bit hashes of surroundings, of hot windows and of texts, made from 128-bit hashes of words.

Defined cases: null or empty text has no words; texts of fewer than WINDOW words stay; a text that
repeats a passage within itself loses it; null and repeated ids do not matter; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 35
GRAM = 8
CHUNK_BYTES = 1 << 20
FILTER_BITS = 28
HOT = 20_000
SALTS = 16
BUFFER_ROWS = 25_000
COMPARED_ROWS = 50_000

_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INDEX = np.uint64((1 << 28) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for x in (_BASES[base], np.uint64(pow(int(_BASES[base]), -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def _prefix(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _power(len(x) + 1, base)[0][: len(x)], out=out[1:], dtype=np.uint64)
    return out


def _between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of [start, end), wherever they lie."""
    return (prefix[end] - prefix[start]) * _power(len(prefix), base)[1][start]


class Parsed:
    """Words, windows and anchors of a chunk of documents."""

    def __init__(self, texts: Sequence[bytes | None], window: int = WINDOW) -> None:
        own = [(t or b"").split() for t in texts]
        self.words = [w for ws in own for w in ws]
        self.n_words = np.array([len(ws) for ws in own], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)]).astype(np.int64)
        self.window, n = window, len(self.words)
        self.h = np.zeros(0, np.uint64)
        self.full = (self.h, self.h)
        self.low = self.count = self.doc = self.left = self.right = np.zeros(0, np.int64)
        if n < window:
            return
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), np.uint64).reshape(-1, 2)
        self.sums = [_prefix(np.ascontiguousarray(halves[:, k]), k) for k in (0, 1)]
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        grams = n - GRAM + 1
        h = np.zeros(grams, np.uint64)
        odd = common.mix64(np.arange(11, 11 + GRAM, dtype=np.uint64)) | np.uint64(1)
        for k in range(GRAM):
            h += halves[k : k + grams, 0] * odd[k]
        h = common.mix64(h)
        least = (h & ~_INDEX) | np.arange(grams, dtype=np.uint64)
        span, width = window - GRAM + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & _INDEX).astype(np.int64)
        inside = np.flatnonzero(doc[: len(at)] == doc[window - 1 : window - 1 + len(at)])
        anchor = at[inside]
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        anchor, self.low = anchor[new], inside[new]
        self.count = np.diff(np.concatenate([new, [len(inside)]]))
        self.h, self.doc = h[anchor], doc[anchor]
        # the words that any window of this anchor could have
        self.left = np.maximum(self.first[self.doc], anchor - (span - 1))
        self.right = np.minimum(self.first[self.doc + 1], anchor + window)
        shape = ((self.low - self.left) * (window + 1) + self.count).astype(np.uint64)
        self.full = tuple(common.mix64(self._hash(self.left, self.right, k) + common.mix64(shape + np.uint64(1 + k))) for k in (0, 1))

    def _hash(self, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
        return common.mix64(_between(self.sums[half], start, end, half) + (end - start).astype(np.uint64))

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, number within it, both halves of the hash) of each window of the given anchors."""
        n = self.count[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = np.repeat(self.low[rows], n) + at
        return np.repeat(rows, n), at, self._hash(s, s + self.window, 0), self._hash(s, s + self.window, 1)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, window: int) -> Iterator[tuple[pa.RecordBatch, Parsed]]:
    """Documents in chunks of about CHUNK_BYTES; a longer one is a chunk of its own."""
    for batch in common.slices(batches):
        texts, at, size = common.as_bytes(batch.column(column)), 0, 0
        for k, text in enumerate(texts):
            size += len(text or b"")
            if size >= CHUNK_BYTES or k == len(texts) - 1:
                yield batch.slice(at, k + 1 - at), Parsed(texts[at : k + 1], window)
                at, size = k + 1, 0


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def anchor_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, n) for every anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _chunks(batches, 0, window):
            h, n = np.unique(own.h, return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(h), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Filter:
    """Two bits for each of some anchors (h)."""

    def __init__(self, anchors: DataFrame, most_bits: int) -> None:
        seen = anchors.count()
        self.bits = int(min(most_bits, max(10, np.ceil(np.log2(16 * max(1, seen))))))
        mask = (1 << self.bits) - 1
        places = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("p")
        words = anchors.select(places).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.any = words.num_rows > 0
        self.table = np.zeros(max(1, 1 << (self.bits - 6)), np.uint64)
        self.table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        mask, out = np.uint64((1 << self.bits) - 1), np.ones(len(h), bool)
        for p in (h & mask, (h >> np.uint64(32)) & mask):
            out &= (self.table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _distinct(own: Parsed, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the anchors ``keep`` one for each surrounding, and how often the chunk has it."""
    if not len(keep):
        return keep, keep
    both = np.stack([own.full[0][keep], own.full[1][keep]], axis=1)
    _, one, n = np.unique(both, axis=0, return_index=True, return_counts=True)
    return keep[one], n


def _surroundings(docs: DataFrame, given, window: int) -> DataFrame:
    """(h, f1, f2, n, first, count, words): what goes to the reference blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = given.value
        for _, own in _chunks(batches, 0, window):
            keep = np.flatnonzero(repeated.may_hold(own.h))
            keep, n = _distinct(own, keep[~hot.may_hold(own.h[keep])] if hot.any else keep)
            words = [b" ".join(own.words[a:b]) for a, b in zip(own.left[keep].tolist(), own.right[keep].tolist(), strict=True)]
            first, count = (x.astype(np.int16) for x in (own.low[keep] - own.left[keep], own.count[keep]))
            yield pa.RecordBatch.from_arrays([_long(own.h[keep]), _long(own.full[0][keep]), _long(own.full[1][keep]), pa.array(n, pa.int64()), pa.array(first), pa.array(count), pa.array(words, pa.binary())], ["h", "f1", "f2", "n", "first", "count", "words"])

    return docs.select("text").mapInArrow(work, "h long, f1 long, f2 long, n long, first short, count short, words binary")


def _hot_windows(docs: DataFrame, given, window: int) -> DataFrame:
    """(f1, f2, mask) of the windows of hot anchors that occur twice or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot = given.value
        for _, own in _chunks(batches, 0, window):
            keep, n = _distinct(own, np.flatnonzero(hot.may_hold(own.h)))
            row, at, g1, g2 = own.windows(keep)
            yield pa.RecordBatch.from_arrays([_long(own.full[0][row]), _long(own.full[1][row]), pa.array(np.repeat(n, own.count[keep]), pa.int64()), pa.array(at, pa.int64()), _long(g1), _long(g2)], ["f1", "f2", "n", "at", "g1", "g2"])

    rows = docs.select("text").mapInArrow(work, "f1 long, f2 long, n long, at long, g1 long, g2 long")
    rows = common.written(rows.groupBy("f1", "f2", "at", "g1", "g2").agg(F.sum("n").alias("n")), "rlz-hot")
    twice = rows.groupBy("g1", "g2").agg(F.sum("n").alias("n")).where("n > 1").select("g1", "g2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("f1"), F.lit(SALTS)).cast("int")).join(twice, ["g1", "g2", "salt"])
    return met.groupBy("f1", "f2").agg(F.bit_or(F.expr("shiftleft(1L, CAST(at AS INT))")).alias("mask"))


def factors(ids: np.ndarray, begin: np.ndarray, first: np.ndarray, count: np.ndarray, n: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Relative Lempel-Ziv factors (row, first window, windows) of a block's surroundings.

    ``ids``: word numbers of all surroundings, one after another from ``begin``; the windows of a surrounding are ``count`` from
    its word ``first``; ``n`` is how often it occurs. A factor of k windows is a passage of k + window - 1 words."""
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[row] + first[row] + at
    seed = common.mix64(_between(_prefix(common.mix64(ids.astype(np.uint64) + np.uint64(1)), 0), start, start + window, 0))
    order = np.argsort(seed, kind="stable")
    # the index: places with one seed, those with equal words next to each other
    group = np.cumsum(np.concatenate([[False], seed[order][1:] != seed[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.bincount(group, minlength=1)
    shared = np.flatnonzero(size[group] > 1)
    head = (np.cumsum(size) - size)[group]
    for k in range(0, len(shared), COMPARED_ROWS):
        part = shared[k : k + COMPARED_ROWS]
        words = lambda place: ids[start[order[place]][:, None] + np.arange(window)]
        other = (words(part) != words(head[part])).any(axis=1)
        for g in np.unique(group[part[other]]).tolist():  # unequal words with one seed: told apart by the words themselves
            members = np.flatnonzero(group == g)
            _, own = np.unique(words(members), axis=0, return_inverse=True)
            group[members] = group.max() + 1 + own.ravel()
    _, group = np.unique(group, return_inverse=True)
    total = np.bincount(group, n[row[order]], minlength=1)
    twice, source = np.zeros(len(row), bool), np.full(len(row), -1)
    twice[order] = total[group] > 1
    # each place's source: the group's first place, for the first itself the second (or itself where the surrounding occurs twice)
    by = np.lexsort((order, group))
    edge = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([edge, [len(by)]]))
    source[order[by]] = np.repeat(order[by[edge]], runs)
    many = runs > 1
    source[order[by[edge[many]]]] = order[by[edge[many] + 1]]
    # a factor goes on while the next window's source follows this window's source in the same surrounding
    goes_on = twice[1:] & twice[:-1] & (row[1:] == row[:-1]) & (source[1:] == source[:-1] + 1) & (row[source[1:]] == row[source[:-1]])
    ends = np.flatnonzero(twice & ~np.concatenate([goes_on, [False]])[: len(twice)])
    begins = np.flatnonzero(twice & ~np.concatenate([[False], goes_on])[: len(twice)])
    return list(zip(row[begins].tolist(), at[begins].tolist(), (ends - begins + 1).tolist(), strict=True))


def _parsed_block(held: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """(f1, f2, mask) of the surroundings of whole blocks that have a factor."""
    f1, f2, n, first, count = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(1, 6))
    lists = pc.split_pattern(pa.chunked_array([b.column(6) for b in held]).combine_chunks(), b" ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    begin = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
    words = lists.flatten().dictionary_encode()
    mask = np.zeros(len(f1), np.int64)
    for row, at, windows in factors(words.indices.to_numpy(), begin, first.astype(np.int64), count.astype(np.int64), n, window):
        mask[row] |= ((1 << windows) - 1) << at
    keep = mask != 0
    return pa.RecordBatch.from_arrays([pa.array(f1[keep]), pa.array(f2[keep]), pa.array(mask[keep])], ["f1", "f2", "mask"])


def _parsed_blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: some whole blocks at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        if size >= BUFFER_ROWS:
            last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
            cut = int(np.searchsorted(h != last, True)) if h[0] == last else 0
            cut = batch.num_rows if h[-1] == last else cut
            if cut:
                held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield _parsed_block(held, window)
            held, size = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield _parsed_block(held, window)


def _text_hash() -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2")]


def _anchored(docs: DataFrame, given, window: int) -> DataFrame:
    """(c1, c2, f1, f2, low): each text's anchors that may repeat; ``low`` is the first window's start in its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (repeated, _), seen = given.value, set()
        for batch, own in _chunks(batches, 2, window):
            c1, c2 = (batch.column(k).to_numpy() for k in (0, 1))
            fresh = np.array([c not in seen and not seen.add(c) for c in zip(c1.tolist(), c2.tolist(), strict=True)], bool)
            if len(seen) > 500_000:
                seen.clear()
            if not len(own.h):
                continue
            keep = np.flatnonzero(repeated.may_hold(own.h) & fresh[own.doc])
            doc = own.doc[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c1[doc]), pa.array(c2[doc]), _long(own.full[0][keep]), _long(own.full[1][keep]), pa.array(own.low[keep] - own.first[doc])], ["c1", "c2", "f1", "f2", "low"])

    return docs.select(*_text_hash(), "text").mapInArrow(work, "c1 long, c2 long, f1 long, f2 long, low long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(c1, c2, starts array<struct<low, mask>>): by text hash, the windows that occur elsewhere too."""
    spark = common.session(docs)
    counts = common.written(anchor_counts(docs, window).where("n > 1"), "rlz-anchors")
    filters = Filter(counts, filter_bits), Filter(counts.where(F.col("n") > hot), filter_bits)
    common.removed(counts)
    given = spark.sparkContext.broadcast(filters)
    blocks = _surroundings(docs, given, window).repartition("h").sortWithinPartitions("h")
    found = blocks.mapInArrow(lambda it: _parsed_blocks(it, window), "f1 long, f2 long, mask long")
    if filters[1].any:
        found = found.unionByName(_hot_windows(docs, given, window))
    matches = common.written(found.groupBy("f1", "f2").agg(F.bit_or("mask").alias("mask")), "rlz-matches")
    met = _anchored(docs, given, window).join(matches, ["f1", "f2"]).select("c1", "c2", F.struct("low", "mask").alias("s"))
    return met.groupBy("c1", "c2").agg(F.collect_set("s").alias("starts"))


def dedup_substrings(docs: DataFrame, carry: Sequence[str] = (), window: int = WINDOW, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, carried, n_words, n_removed, factors array<struct<start,end>>, kept_text) for each row of ``docs``.

    ``factors``: the removed word ranges; kept words are joined by one blank."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), common.carried(docs, carry).alias("carried"))
    starts = repeated_windows(base, window, filter_bits, hot)
    both = base.select("*", *_text_hash()).join(starts, ["c1", "c2"], "left").select("doc_id", "text", "carried", "starts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(window)
        for batch in common.slices(batches):
            cols: list[list] = [[], [], [], []]
            for text, found in zip(common.as_bytes(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if found:
                    low = np.array([s["low"] for s in found])
                    mask = np.array([s["mask"] for s in found], np.int64)
                    row, bit = np.nonzero((mask[:, None] >> bits[None, :]) & 1)
                    s = np.unique(low[row] + bit)
                    gone[s] += 1
                    np.subtract.at(gone, s + window, 1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                cols[0].append(len(words))
                cols[1].append(int(gone.sum()))
                cols[2].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                cols[3].append(b" ".join(words if not found else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            own = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own, pa.array(cols[3], pa.binary()).cast(pa.string())], ["doc_id", "carried", "n_words", "n_removed", "factors", "kept_text"])

    return both.mapInArrow(work, f"doc_id long, carried {base.schema['carried'].dataType.simpleString()}, n_words long, n_removed long, factors array<struct<start: bigint, end: bigint>>, kept_text string")
