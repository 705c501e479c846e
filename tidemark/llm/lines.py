"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
``min_chars`` code points or more that ``min_docs`` documents or more hold lose all their lines,
except in the document with the largest id among the holders.

The exact table (key digest, documents, largest id) is counted by Spark with map-side combining, so
a line that a third of all documents hold is one row per map task. Repeated keys also go into
cuckoo filters, one per shard of the key space, as many shards as the keys need; a scan of the documents asks the filters first
and the exact table only for what they let through. Filters up to ``filter_bytes`` go to every task; beyond, a document's keys go
to the tasks that hold their shards, ``SALTS`` a shard. Exact tables above ``exact_rows`` are joined instead of broadcast. All
these are other plans with equal rows.

``LineIndex`` keeps postings, exact counts and filters up to date: an insertion or a deletion counts the keys it touches anew,
and the filters gain or lose the keys whose count crosses ``min_docs``.

Defined cases: null or empty text is one empty line; deleting what is not in the index is an error; a null doc_id counts as a document and is
smaller than any other id (among null ids only, all keep the line); rows that repeat a doc_id are
documents of their own, and all rows with the largest id keep the line; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_BITS = 4
SHARD_KEYS = 1 << 18
SALTS = 16
MOST_CHANGES = 8
SLOTS = 4
FILTER_BYTES = 32 << 20
EXACT_ROWS = 100_000


class CuckooFilter:
    """Four slots a bucket, 16-bit fingerprints, partial-key cuckoo hashing; supports deletion.

    Keys are pairs of unsigned 64-bit integers (the two halves of a digest)."""

    def __init__(self, capacity: int) -> None:
        self.buckets = 1 << max(3, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        self = cls(len(hi))
        keys = list(zip(hi.tolist(), lo.tolist(), strict=True))
        while not all(self.insert(a, b) for a, b in keys):
            grown = cls(self.buckets * SLOTS)
            self.buckets, self.table = grown.buckets, grown.table
        return self

    @classmethod
    def loaded(cls, buckets: int, table: bytes) -> CuckooFilter:
        self = cls(1)
        self.buckets, self.table = buckets, np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()
        return self

    def _places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark = max(lo & 0xFFFF, 1)
        one = hi & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (_TURNS[mark] & (self.buckets - 1))

    def insert(self, hi: int, lo: int) -> bool:
        """False: too full, and nothing has changed."""
        mark, at, other = self._places(hi, lo)
        table, moved, turn = self.table, [], mark
        for step in range(500):
            for bucket in (at, other) if step == 0 else (at,):
                row = table[bucket].tolist()
                if 0 in row:
                    table[bucket, row.index(0)] = turn
                    return True
            slot = (turn + step) % SLOTS
            moved.append((at, slot, turn))
            turn, table[at, slot] = int(table[at, slot]), turn
            at = self._other(at, turn)
        for at, slot, before in reversed(moved):
            turn, table[at, slot] = before, turn
        return False

    def delete(self, hi: int, lo: int) -> bool:
        mark, one, two = self._places(hi, lo)
        for bucket in (one, two):
            row = self.table[bucket].tolist()
            if mark in row:
                self.table[bucket, row.index(mark)] = 0
                return True
        return False

    def may_hold(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.buckets - 1)
        mark = np.maximum(lo & np.uint64(0xFFFF), np.uint64(1))
        one = (hi & mask).astype(np.int64)
        two = one ^ (common.mix64(mark) & mask).astype(np.int64)
        mark = mark.astype(np.uint16)[:, None]
        return ((self.table[one] == mark) | (self.table[two] == mark)).any(axis=1)

    def marks(self) -> list[tuple[int, int]]:
        """(the lesser of its two buckets, fingerprint) of each key held: what does not depend on the order of insertion."""
        bucket, slot = np.nonzero(self.table)
        held = self.table[bucket, slot].tolist()
        return sorted((min(b, self._other(b, m)), m) for b, m in zip(bucket.tolist(), held, strict=True))


#: Where each fingerprint's other bucket lies, before the number of buckets cuts it.
_TURNS = common.mix64(np.arange(1 << 16, dtype=np.uint64)).tolist()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or None for one that is too short to count."""
    key = line.strip()
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _base(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), common.carried(docs, carry).alias("carried"))


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (hi, lo, doc_id) for each document and distinct key of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            digests: list[bytes] = []
            ids: list[int | None] = []
            for doc, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                own = {key for line in (text or b"").split(b"\n") if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None}
                digests += map(xxhash.xxh3_128_digest, own)
                ids += [doc] * len(own)
            hi, lo = _halves(digests)
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, "hi long, lo long, doc_id long")


def reference_counts(postings: DataFrame) -> DataFrame:
    """The exact table: (hi, lo, n_docs, last_doc)."""
    return postings.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_of(hi: np.ndarray, bits: int) -> np.ndarray:
    return (hi >> np.uint64(64 - bits)).astype(np.int64)


def shard_bits(keys: int) -> int:
    """Shards grow with the keys, so a filter stays small."""
    return max(SHARD_BITS, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


FILTER = "shard long, part long, buckets long, filter binary"


def _filter_rows(shard: int, own: list[CuckooFilter]) -> pa.RecordBatch:
    n = len(own)
    return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([f.buckets for f in own], pa.int64()), pa.array([f.table.tobytes() for f in own], pa.binary())], ["shard", "part", "buckets", "filter"])


def cuckoo_shards(counts: DataFrame, bits: int = SHARD_BITS) -> DataFrame:
    """One filter per shard, built where the shard's keys are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard, hi, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for at in np.unique(shard).tolist():
                if at != now and held:
                    yield _filter_rows(now, [CuckooFilter.of(*(np.concatenate([x[k] for x in held]).view(np.uint64) for k in (0, 1)))])
                    held = []
                now = at
                held.append((hi[shard == at], lo[shard == at]))
        if held:
            yield _filter_rows(now, [CuckooFilter.of(*(np.concatenate([x[k] for x in held]).view(np.uint64) for k in (0, 1)))])

    by = F.shiftrightunsigned("hi", 64 - bits).alias("shard")
    return counts.select(by, "hi", "lo").repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(work, FILTER)


def updated_shards(filters: DataFrame, changes: DataFrame, bits: int) -> DataFrame:
    """The filters after ``changes`` (hi, lo, step): a key goes in for step 1 and out for -1. A shard that is full goes on in a further part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            for shard, step, buckets, table, hi, lo in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                if shard != now:
                    if own:
                        yield _filter_rows(now, own)
                    now, own = shard, []
                if step is None:
                    own.append(CuckooFilter.loaded(buckets, table))
                    continue
                hi, lo = hi & (1 << 64) - 1, lo & (1 << 64) - 1
                if step < 0:
                    if not any(f.delete(hi, lo) for f in own):
                        raise RuntimeError("a key to delete is in no filter of its shard")
                elif not any(f.insert(hi, lo) for f in own):
                    own.append(CuckooFilter(4 * SLOTS * own[-1].buckets if own else 1))
                    own[-1].insert(hi, lo)
        if own:
            yield _filter_rows(now, own)

    none = lambda kind: F.lit(None).cast(kind)
    old = filters.select("shard", none("long").alias("step"), "part", "buckets", "filter", none("long").alias("hi"), none("long").alias("lo"))
    new = changes.select(F.shiftrightunsigned("hi", 64 - bits).alias("shard"), F.col("step").cast("long").alias("step"), none("long").alias("part"), none("long").alias("buckets"), none("binary").alias("filter"), "hi", "lo")
    # a shard's filters first, then what goes out, then what comes in
    both = old.unionByName(new).repartition(1 << bits, "shard").sortWithinPartitions("shard", F.col("step").asc_nulls_first(), "part", "hi", "lo")
    return both.mapInArrow(work, FILTER)


def _loaded(rows: list) -> dict[int, list[CuckooFilter]]:
    out: dict[int, list[CuckooFilter]] = {}
    for shard, _, buckets, table in rows:
        out.setdefault(shard, []).append(CuckooFilter.loaded(buckets, table))
    return out


def _passing(filters: dict[int, list[CuckooFilter]], bits: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out, shards = np.zeros(len(hi), bool), shard_of(hi, bits)
    for shard in np.unique(shards).tolist():
        own = np.flatnonzero(shards == shard)
        for f in filters.get(shard, ()):
            out[own] |= f.may_hold(hi[own], lo[own])
    return out


def _split(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    lines = (text or b"").split(b"\n")
    at, digests = [], []
    for k, line in enumerate(lines):
        if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
            at.append(k)
            digests.append(xxhash.xxh3_128_digest(key))
    return lines, at, digests


def _rebuilt(batch: pa.RecordBatch, drops: list[tuple[list[bytes], set[int]]], texts: list[bytes | None]) -> pa.RecordBatch:
    kept = [text if text is not None and not gone else b"\n".join(x for k, x in enumerate(lines) if k not in gone) for text, (lines, gone) in zip(texts, drops, strict=True)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), pa.array([len(x) for x, _ in drops], pa.int64()), pa.array([len(g) for _, g in drops], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        ["doc_id", "carried", "n_lines", "n_dropped", "kept_text"],
    )


def dedup_lines(docs: DataFrame, carry: Sequence[str] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(doc_id, carried struct of ``carry``, n_lines, n_dropped, kept_text) for each row of ``docs``."""
    counts = common.written(reference_counts(line_postings(docs, min_chars)).where(F.col("n_docs") >= min_docs), "line-counts")
    bits = shard_bits(counts.count())
    return apply_counts(docs, counts, common.written(cuckoo_shards(counts, bits), "line-filters"), bits, carry, min_chars, filter_bytes, exact_rows)


def apply_counts(docs: DataFrame, counts: DataFrame, shards: DataFrame, bits: int, carry: Sequence[str] = (), min_chars: int = MIN_CHARS, filter_bytes: int = FILTER_BYTES, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Drops the lines that ``counts`` (hi, lo, last_doc; repeated keys only) names; ``shards`` are its filters."""
    spark = common.session(docs)
    base = _base(docs, carry)
    schema = f"doc_id long, carried {base.schema['carried'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string"
    total = shards.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    filters = spark.sparkContext.broadcast([tuple(r) for r in shards.collect()]) if total <= filter_bytes else None

    if filters is None or counts.count() > exact_rows:
        return _by_join(base, counts, shards, filters, bits, schema, min_chars)

    rows = counts.select("hi", "lo", "last_doc").collect()
    exact = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in rows})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = _loaded(filters.value), exact.value
        for batch in common.slices(batches):
            texts = common.as_bytes(batch.column(1))
            parts = [_split(t, min_chars) for t in texts]
            hi, lo = _halves([d for p in parts for d in p[2]])
            maybe = _passing(own, bits, hi, lo)
            hi, lo = hi.view(np.int64), lo.view(np.int64)
            drops, k = [], 0
            for doc, (lines, at, _) in zip(batch.column(0).to_pylist(), parts, strict=True):
                gone = set()
                for j, line in enumerate(at, k):
                    if maybe[j] and (key := (int(hi[j]), int(lo[j]))) in table and table[key] != doc:
                        gone.add(line)
                k += len(at)
                drops.append((lines, gone))
            yield _rebuilt(batch, drops, texts)

    return base.mapInArrow(work, schema)


def _by_join(base: DataFrame, counts: DataFrame, shards: DataFrame, filters, bits: int, schema: str, min_chars: int) -> DataFrame:
    """The way for tables too large to broadcast: what the filters let through meets the exact table in a join."""
    names = ["doc_id", "cid", "hi", "lo"]
    kinds = "doc_id long, cid long, hi long, lo long"

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if filters is None else _loaded(filters.value)
        for batch in common.slices(batches):
            digests, docs = [], []
            for k, text in enumerate(common.as_bytes(batch.column(1))):
                found = set(_split(text, min_chars)[2])
                digests += found
                docs += [k] * len(found)
            hi, lo = _halves(digests)
            keep = np.ones(len(hi), bool) if own is None else _passing(own, bits, hi, lo)
            at = pa.array(np.array(docs, np.int64)[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(hi[keep].view(np.int64)), pa.array(lo[keep].view(np.int64))], names)

    keyed = base.withColumn("cid", F.xxhash64("text"))
    flagged = keyed.select("doc_id", "text", "cid").mapInArrow(flag, kinds)
    if filters is None:
        flagged = _screened(flagged, shards, bits, names, kinds)
    gone = (
        flagged.join(counts.select("hi", "lo", "last_doc"), ["hi", "lo"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy("doc_id", "cid")
        .agg(F.collect_set(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))).alias("gone"))
    )
    g = gone.select(F.col("doc_id").alias("g_doc"), F.col("cid").alias("g_cid"), "gone")
    both = keyed.join(g, keyed["doc_id"].eqNullSafe(g["g_doc"]) & keyed["cid"].eqNullSafe(g["g_cid"]), "left").select("doc_id", "text", "carried", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, drops = common.as_bytes(batch.column(1)), []
            for text, gone_keys in zip(texts, batch.column(3).to_pylist(), strict=True):
                lines, at, digests = _split(text, min_chars)
                names = {bytes.fromhex(x) for x in gone_keys or ()}
                drops.append((lines, {k for k, d in zip(at, digests, strict=True) if d in names}))
            yield _rebuilt(batch, drops, texts)

    return both.mapInArrow(work, schema)


def _screened(keys: DataFrame, shards: DataFrame, bits: int, names: list[str], kinds: str) -> DataFrame:
    """The rows of ``keys`` that the filters let through, where the filters are: a task reads a shard's filters, then its share of the keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            shard, salt, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if (shard[a], salt[a]) != now:
                    now, own = (shard[a], salt[a]), []
                first = a + int((part[a:b] >= 0).sum())
                own += [CuckooFilter.loaded(batch.column(3)[k].as_py(), batch.column(4)[k].as_py()) for k in range(a, first)]
                rows = batch.slice(first, b - first)
                hi, lo = (rows.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (7, 8))
                keep = np.zeros(len(hi), bool)
                for f in own:
                    keep |= f.may_hold(hi, lo)
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([rows.column(k).take(at) for k in range(5, 9)], names)

    none = lambda kind: F.lit(None).cast(kind)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    held = shards.select("shard", each, "part", "buckets", "filter", *[none("long").alias(c) for c in names])
    asked = keys.select(F.shiftrightunsigned("hi", 64 - bits).alias("shard"), F.pmod("cid", F.lit(SALTS)).cast("long").alias("salt"), F.lit(-1).cast("long").alias("part"), none("long").alias("buckets"), none("binary").alias("filter"), *names)
    both = held.unionByName(asked).repartition(SALTS << bits, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("part").desc())
    return both.mapInArrow(work, kinds)


class LineIndex:
    """Incremental form, in tables of the shared folder.

    ``postings``: (hi, lo, doc_id, n), a table for each change, n below 0 for what was deleted. ``counts``: (hi, lo, n_docs, last_doc), a
    table for each change with the keys it touched. ``filters``: the cuckoo filters of the keys in ``min_docs`` documents or more.
    ``insert`` and ``delete`` write what changes and give back a new index; the old one stays usable. Deleting what was
    inserted restores counts and filters exactly, so dedup is reversible. Beyond ``MOST_CHANGES`` tables they are merged."""

    def __init__(self, postings: list[DataFrame], counts: list[DataFrame], filters: DataFrame, bits: int, min_chars: int, min_docs: int) -> None:
        self.tables, self.versions, self.filters, self.bits, self.min_chars, self.min_docs = postings, counts, filters, bits, min_chars, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        postings = common.written(line_postings(docs, min_chars).groupBy("hi", "lo", "doc_id").agg(F.count(F.lit(1)).alias("n")), "line-postings")
        return cls._over(postings, common.written(_counted(postings), "line-refs"), min_chars, min_docs)

    @classmethod
    def _over(cls, postings: DataFrame, counts: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
        repeated = counts.where(F.col("n_docs") >= min_docs)
        bits = shard_bits(repeated.count())
        return cls([postings], [counts], common.written(cuckoo_shards(repeated, bits), "line-filters"), bits, min_chars, min_docs)

    @property
    def postings(self) -> DataFrame:
        """(hi, lo, doc_id, n) as it stands."""
        return _summed(reduce(DataFrame.unionByName, self.tables)).where("n > 0")

    @property
    def counts(self) -> DataFrame:
        """(hi, lo, n_docs, last_doc) as it stands."""
        if len(self.versions) == 1:
            return self.versions[0]
        each = [t.select("hi", "lo", F.struct(F.lit(k).alias("version"), "n_docs", "last_doc").alias("v")) for k, t in enumerate(self.versions)]
        return reduce(DataFrame.unionByName, each).groupBy("hi", "lo").agg(F.max_by("v", "v.version").alias("v")).select("hi", "lo", "v.n_docs", "v.last_doc").where("n_docs > 0")

    def _changed(self, delta: DataFrame) -> LineIndex:
        """The index with the postings ``delta`` (hi, lo, doc_id, n); only keys in it are counted anew."""
        delta = common.written(delta, "line-postings")
        touched = delta.select("hi", "lo").distinct()
        tables = [*self.tables, delta]
        own = common.written(_summed(reduce(DataFrame.unionByName, tables).join(touched, ["hi", "lo"], "left_semi")), "line-touched")
        if own.where("n < 0").head(1):
            raise ValueError("rows to delete are not in the index")
        before = self.counts.join(touched, ["hi", "lo"], "left_semi").select("hi", "lo", F.col("n_docs").alias("was"))
        after = touched.join(_counted(own.where("n > 0")), ["hi", "lo"], "left").join(before, ["hi", "lo"], "left")
        after = common.written(after.select("hi", "lo", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), "last_doc", F.coalesce("was", F.lit(0).cast("long")).alias("was")), "line-refs")
        common.removed(own)
        step = (F.col("n_docs") >= self.min_docs).cast("int") - (F.col("was") >= self.min_docs).cast("int")
        changes = after.select("hi", "lo", step.alias("step")).where("step <> 0")
        filters = common.written(updated_shards(self.filters, changes, self.bits), "line-filters")
        new = LineIndex(tables, [*self.versions, after.drop("was")], filters, self.bits, self.min_chars, self.min_docs)
        return new if len(tables) <= MOST_CHANGES else new.merged()

    def merged(self) -> LineIndex:
        """The same index in one table each, its shards as many as its keys need now."""
        return LineIndex._over(common.written(self.postings, "line-postings"), common.written(self.counts, "line-refs"), self.min_chars, self.min_docs)

    def _signed(self, docs: DataFrame, sign: int) -> DataFrame:
        return line_postings(docs, self.min_chars).groupBy("hi", "lo", "doc_id").agg((F.count(F.lit(1)) * sign).alias("n"))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(self._signed(docs, 1))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Without the rows ``docs`` (doc_id, text), one for each; other rows with the same ids stay."""
        return self._changed(self._signed(docs, -1))

    def delete_ids(self, doc_ids: DataFrame) -> LineIndex:
        """Without any row whose id is in ``doc_ids`` (doc_id; null stands for rows without id)."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        rows = self.postings
        return self._changed(rows.join(ids, rows["doc_id"].eqNullSafe(ids["gone"]), "left_semi").select("hi", "lo", "doc_id", (-F.col("n")).alias("n")))

    def apply(self, docs: DataFrame, carry: Sequence[str] = (), **options: int) -> DataFrame:
        counts = common.written(self.counts.where(F.col("n_docs") >= self.min_docs), "line-counts")
        return apply_counts(docs, counts, self.filters, self.bits, carry, self.min_chars, **options)


def _summed(postings: DataFrame) -> DataFrame:
    return postings.groupBy("hi", "lo", "doc_id").agg(F.sum("n").alias("n")).where("n <> 0")


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("last_doc"))
