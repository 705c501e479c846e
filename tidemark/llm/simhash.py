"""SimHash near-dedup over pivot distance tables.

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words (repeats count;
fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42; a bit is 1 where more
than half of the hashes have it.

Linking works on distinct fingerprints, so copies of a text cost one row. The pivot distance table, written once,
holds each fingerprint's Hamming distances to ``PIVOTS`` pseudo-random reference fingerprints, one byte a coordinate. Two fingerprints
within ``radius`` bits of each other differ by at most ``radius`` in every coordinate. One coordinate lets 46 % of random pairs
pass, so bands of coordinates give no key to join on that holds for large tables (figures in the README); rows meet by fingerprint
bits instead: of five blocks, two at least must agree. Within such a bucket rows are sorted by their first coordinate, pairs
whose largest coordinate difference exceeds ``radius`` are discarded, and the survivors are verified. A bucket gives back a spanning forest
of its links, never its pairs. A bucket above ``BUCKET_ROWS`` fingerprints is dealt out again by
sub-blocks of the remaining bits, where again some must agree, so no task gathers a hot bucket
and no link is lost. Links become components by alternating large-star and small-star steps.

Defined cases: null text is a text without words; rows without words link to each other and to
whatever lies near zero; repeated rows share a fingerprint; a null doc_id takes no part in the
smallest id of a component (null where a component has no other); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
RADIUS = 3
BLOCKS = 5
PIVOTS = 16
BUCKET_ROWS = 4096
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    grams = [b" ".join(words)] if len(words) <= shingle else [b" ".join(g) for g in zip(*(words[k:] for k in range(n)), strict=False)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: Sequence[str] = (), shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, carried, fp long) for each row; text is read whole and goes no further."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), common.carried(docs, carry).alias("carried"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in common.as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "carried", "fp"])

    return base.mapInArrow(work, f"doc_id long, carried {base.schema['carried'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Pseudo-random reference fingerprints."""
    return common.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, c0, c1): each fingerprint's distances to the references, eight one-byte coordinates to a long."""
    refs = pivots()
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)).cast("long"))).cast("long") for p in refs.view(np.int64)]
    packed = [reduce(Column.bitwiseOR, [F.shiftleft(c, 8 * k) for k, c in enumerate(far[at : at + 8])]) for at in (0, 8)]
    return fps.select("fp", packed[0].alias("c0"), packed[1].alias("c1"))


def _block_masks(blocks: int, bits: Sequence[int] = tuple(range(64))) -> list[int]:
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), blocks)]


def _forest(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one bucket: the pivot table's rows discard, exact distances verify."""
    n = len(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    parent = np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    left, right = [], []
    for i in range(n):
        js = np.arange(i + 1, ends[i])
        if not len(js):
            continue
        for p in range(1, table.shape[1], 4):
            js = js[(np.abs(table[js, p : p + 4] - table[i, p : p + 4]) <= radius).all(axis=1)]
        js = js[np.bitwise_count(fps[js] ^ fps[i]) <= radius]
        for j in js:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(int(j))
    return fps[left], fps[right]


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, fp, c0, c1), sorted by key: one bucket at a time is in memory."""

    def done(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        if len(rows) > 1:
            a, b = _forest(rows[:, 0].copy().view(np.uint64), rows[:, 1:].copy().view(np.int8), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    key, held = None, []
    for batch in batches:
        k1, k2, *cols = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if not len(k1):
            continue
        edges = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        for part, at in zip(np.split(np.stack(cols, axis=1), edges), [0, *edges], strict=True):
            own = (int(k1[at]), int(k2[at]))
            if own != key and held:
                if sum(map(len, held)) > 1:
                    yield from done(held)
                held = []
            key = own
            held.append(part)
    if held:
        yield from done(held)


def _keyed(rows: DataFrame, tables: list[tuple[int, int, int]]) -> DataFrame:
    """(k1, k2, fp, c0, c1): each row (fp, k1, c0, c1) in all tables (k1 before, new k1, bits) that go on from its own."""
    values = ", ".join(f"(CAST({above} AS BIGINT), CAST({k} AS BIGINT), CAST({_signed(mask)} AS BIGINT))" for above, k, mask in tables)
    given = F.broadcast(common.session(rows).sql(f"SELECT * FROM VALUES {values} AS t(above, k, mask)"))  # 50 rows at most
    return rows.join(given, rows["k1"] == given["above"]).select(F.col("k").alias("k1"), F.col("fp").bitwiseAND(F.col("mask")).alias("k2"), "fp", "c0", "c1")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links within ``radius`` bits that connect whatever all such links connect.

    ``fps``: distinct fingerprints in a column fp."""
    spark = common.session(fps)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: buckets are few bytes but much work
    table = common.written(pivot_table(fps), "simhash-pivots")
    masks = _block_masks(blocks)
    tables = [(0, k, sum(masks[i] for i in combo)) for k, combo in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = _keyed(table.withColumn("k1", F.lit(0).cast("long")), tables)
    found = None
    for level in range(2):
        sizes = common.written(keyed.groupBy("k1", "k2").count().where("count > 1"), "simhash-buckets")
        few = sizes.where(F.col("count") <= bucket_rows).select("k1", "k2")
        part = keyed.join(few, ["k1", "k2"]).select("k1", "k2", "fp", "c0", "c1")
        own = part.repartition(tasks, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(lambda it, r=radius: _bucket_links(it, r), "a long, b long")
        found = own if found is None else found.unionByName(own)
        many = sizes.where(F.col("count") > bucket_rows).select("k1", "k2")
        if not many.head(1):
            return found
        hot = keyed.join(many, ["k1", "k2"]).select("fp", "k1", "c0", "c1")
        if level == 0:
            # of the bits that a hot bucket's key leaves open, radius + 1 sub-blocks, one of which must agree
            finer = []
            for _, k, mask in tables:
                rest = [b for b in range(64) if not mask >> b & 1]
                finer += [(k, (k + 1) * 100 + j, mask | sub) for j, sub in enumerate(_block_masks(radius + 1, rest))]
            keyed, tables = _keyed(hot, finer), finer
    # fingerprints of a bucket that is still hot meet at points between them
    return found.unionByName(_by_neighbours(hot.select("fp").distinct(), radius))


def _by_neighbours(hot: DataFrame, radius: int) -> DataFrame:
    """Links of hot fingerprints by meeting points.

    All that lie within ``near`` changes of a point and the least that lies within ``far`` of it are
    at most ``radius`` apart, and any two that are that close have such a point between them."""
    far = radius // 2
    near = radius - far

    def around(df: DataFrame, most: int) -> DataFrame:
        flips = [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(64), n)]
        return df.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in flips])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("at"))

    least = around(hot, far).groupBy("at").agg(F.min("fp").alias("b"))
    return around(hot, near).join(least, "at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable."""
    now = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = common.written(small, "cc")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.removed(now)
        now = new
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_groups(docs: DataFrame, carry: Sequence[str] = (), radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, carried, fp, component_id, root) for each row of ``docs``; ``root`` names the component, also where no row of it has an id."""
    rows = common.written(fingerprints(docs, carry, shingle), "simhash-rows")
    nodes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    found = components(links(nodes.select("fp"), radius))
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = common.written(linked.join(least, "root").select("fp", "root", "component_id"), "simhash-groups")
    common.removed(found)
    every = nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("first_doc")).alias("component_id"))
    return rows.join(every, "fp").select("doc_id", "carried", "fp", "component_id", "root")
