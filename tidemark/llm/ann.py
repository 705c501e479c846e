"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Trees are fitted on a bounded sample of vectors (``FIT_ROWS`` rows and ``FIT_BYTES`` bytes at most;
smaller tables are fitted whole). A node's hyperplane lies between the means of two random seeds'
neighbourhoods, at the median of its sample points. For inner products, vectors get one more
component, sqrt(M^2 - |x|^2), M the largest norm; queries get 0 there. Every row is indexed: it falls into
one leaf of each tree. A query walks all trees through one priority queue of margins until it has
visited a number of leaves that is fitted too: the least one by which ``CALIBRATION_QUERIES`` rows of the sample
find ``RECALL`` of their true neighbours in it. Leaves are reranked where they are: each gives a query its best
``k`` by the exact double-precision inner product of the original vectors, and the best of all
leaves win. Leaves with more than ``LEAF_ROWS`` rows or ``LEAF_QUERIES`` queries are dealt out in
chunks, every query chunk to every row chunk, so a leaf full of copies is searched whole but not in one task.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components, and rows without vec_id, take no part, as queries or as candidates. Rows that share
the query's vec_id are its own. A row repeated with equal vector counts once. Ties go to the smaller
vec_id. With fewer than ``k`` candidates all are returned; no rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

TREES = 8
RECALL = 0.96
CALIBRATION_QUERIES = 256
FIT_ROWS = 65_536
FIT_BYTES = 32 << 20
LEAF = 1024
LEAF_ROWS = 4096
LEAF_QUERIES = 8192
LEAF_GROUP = 8
HELD = 1 << 20
K = 20


def _matrix(column: pa.Array, dim: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part, and their vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    fits = np.flatnonzero((np.diff(offsets) == dim) & np.asarray(column.is_valid()))
    values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    x = values[offsets[fits][:, None] + np.arange(dim)[None, :]] if len(fits) else np.zeros((0, dim), kind)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return fits[good], x[good]


class Forest:
    """Node arrays of all trees; ``child`` is -(leaf + 1) at leaves."""

    def __init__(self, sample: np.ndarray, top: float, leaf: int, trees: int = TREES, seed: int = 11) -> None:
        self.top = top
        x = self.lifted(sample)
        self.normal: list[np.ndarray] = []
        self.offset: list[float] = []
        self.child: list[list[int]] = []
        self.leaves, self.roots = 0, []
        for t in range(trees):
            self.roots.append(self._grow(x, np.arange(len(x)), leaf, np.random.default_rng(seed + t)))
        self.normals = np.array(self.normal, np.float32).reshape(len(self.normal), x.shape[1])
        self.offsets, self.children = np.array(self.offset), np.array(self.child, np.int64).reshape(-1, 2)
        self.normal, self.offset, self.child = [], [], []

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, more]).astype(np.float32)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        stack, root = [(rows, -1, 0)], None
        while stack:
            rows, above, side = stack.pop()
            cut = self._cut(x[rows], rng) if len(rows) > leaf else None
            if cut is None:
                me = -(self.leaves + 1)
                self.leaves += 1
            else:
                normal, offset, right = cut
                me = len(self.normal)
                self.normal.append(normal)
                self.offset.append(offset)
                self.child.append([0, 0])
                stack += [(rows[~right], me, 0), (rows[right], me, 1)]
            if above >= 0:
                self.child[above][side] = me
            else:
                root = me
        return root

    @staticmethod
    def _cut(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        part = x[rng.choice(len(x), min(len(x), 256), replace=False)]
        a, b = part[0], part[-1]
        for _ in range(4):
            near = ((part - a) ** 2).sum(axis=1) < ((part - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = part[near].mean(axis=0), part[~near].mean(axis=0)
        normal = b - a
        size = float(np.sqrt((normal * normal).sum()))
        if size < 1e-12:
            return None
        normal = (normal / size).astype(np.float32)
        at = x @ normal
        offset = float(np.median(at))
        right = at > offset
        return None if right.all() or not right.any() else (normal, offset, right)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: rows x trees."""
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while len(inner := np.flatnonzero(at >= 0)):
                n = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.normals[n]) > self.offsets[n]
                at[inner] = self.children[n, right.astype(np.int64)]
            out[:, t] = -at - 1
        return out

    def search(self, q: np.ndarray, probes: int) -> list[list[int]]:
        """Leaves to visit for each query, by one queue over all trees."""
        margins = self.lifted(q, True) @ self.normals.T - self.offsets[None, :] if len(self.normals) else np.zeros((len(q), 0))
        children = self.children.tolist()
        out = []
        for own in margins:
            own = own.tolist()
            heap = [(-np.inf, root) for root in self.roots]
            heapq.heapify(heap)
            found: list[int] = []
            while heap and len(found) < probes:
                far, node = heapq.heappop(heap)
                if node < 0:
                    found.append(-node - 1)
                    continue
                left, right = children[node]
                heapq.heappush(heap, (max(far, own[node]), left))
                heapq.heappush(heap, (max(far, -own[node]), right))
            out.append(found)
        return out


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Exact best ``k`` of (ids, x) for each query: largest score first, then smaller id."""
    q64, x64 = q.astype(np.float64), x.astype(np.float64)
    outs: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q64), 256):
        rough = q64[at : at + 256] @ x64.T
        for i, row in enumerate(rough, at):
            row[ids == q_ids[i]] = -np.inf
            m = min(k, len(row))
            least = np.partition(row, len(row) - m)[len(row) - m]
            slack = 1e-9 * max(1.0, abs(float(row.max())) if np.isfinite(row.max()) else 1.0)
            js = np.flatnonzero((row >= least - slack) & np.isfinite(row))
            exact = (x64[js] * q64[i][None, :]).sum(axis=1)
            order = np.lexsort((ids[js], -exact))[:k]
            outs[0].append(np.full(len(order), q_ids[i]))
            outs[1].append(ids[js][order])
            outs[2].append(exact[order])
    return outs


def probes_for(forest: Forest, sample: np.ndarray, recall: float, k: int) -> int:
    """The least number of leaves that finds ``recall`` of the sample's true neighbours within the sample."""
    total = max(1, forest.leaves)
    if len(sample) < 2:
        return total
    rng = np.random.default_rng(3)
    asked = rng.choice(len(sample), min(len(sample), CALIBRATION_QUERIES), replace=False)
    leaves = forest.assign(sample)
    x, at = sample.astype(np.float64), []
    for q, order in zip(asked, forest.search(sample[asked], total), strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        m = min(k, len(x) - 1)
        near = np.argpartition(-score, m - 1)[:m]
        turn = np.zeros(total, np.int64)
        turn[order] = np.arange(1, len(order) + 1)
        at.append(turn[leaves[near]].min(axis=1))
    turns = np.sort(np.concatenate(at))
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))])


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of each query among what was found so far; a pair counts once."""
    q, v, s = (np.concatenate([p[j] for p in parts]) for j in range(3))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    q, v, s = q[new], v[new], s[new]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def _rerank(batches: Iterator[pa.RecordBatch], kind: np.dtype, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, is_query, id, vec) sorted by part and is_query: a part's rows, then its queries."""
    part, held, ids, x = None, [], None, None
    found: list[tuple] = []
    size = 0

    def batch_of(own: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(o) for o in own], ["query_id", "vec_id", "score"])

    for batch in batches:
        parts = batch.column(0).to_numpy()
        query = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        own_ids, raw = batch.column(2).to_numpy(), batch.column(3)
        edges = np.flatnonzero((parts[1:] != parts[:-1]) | (query[1:] != query[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(parts)], strict=True):
            if a == b:
                continue
            if parts[a] != part:
                part, held, x = parts[a], [], None
            vecs = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), kind).reshape(b - a, -1)
            if not query[a]:
                held.append((own_ids[a:b], vecs))
                continue
            if not held:
                continue
            if x is None:
                ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                if len(np.unique(ids)) < len(ids):  # repeated rows lie in the same part
                    first = {(int(i), v.tobytes()): k for k, (i, v) in reversed(list(enumerate(zip(ids, x, strict=True))))}
                    keep = sorted(first.values())
                    ids, x = ids[keep], x[keep]
            found.append(tuple(np.concatenate(o) for o in best_of(own_ids[a:b], vecs, ids, x, k)))
            size += len(found[-1][0])
            if size > HELD:
                found = [_merged(found, k)]
                size = len(found[0][0])
                if 2 * size > HELD:
                    yield batch_of(found[0])
                    found, size = [], 0
    if found:
        yield batch_of(_merged(found, k))


def vectors(table: DataFrame) -> tuple[DataFrame, np.dtype, int]:
    """Rows that take part as (vec_id, norm, vec binary), the component type and the length of most rows."""
    kind = np.dtype("<f4") if "float" in dict(table.dtypes)["embedding"] else np.dtype("<f8")
    own = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    sizes = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(1), dim, kind)
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(norms), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "norm", "vec"])

    return common.written(own.mapInArrow(work, "vec_id long, norm double, vec binary"), "ann-vectors"), kind, dim


def neighbours(table: DataFrame, is_query: Column, k: int = K, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row for which ``is_query`` (of vec_id) holds."""
    spark = common.session(table)
    base, kind, dim = vectors(table)
    seen = base.agg(F.count(F.lit(1)), F.max("norm")).first()
    n, top = seen[0], seen[1] or 1.0
    bound = max(256, min(FIT_ROWS, FIT_BYTES // (dim * kind.itemsize)))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, bound / max(1, n)))
    sample = base.where(part).select("vec").limit(2 * bound).toArrow().column(0).to_pylist()
    fitted = np.frombuffer(b"".join(sample), kind).reshape(-1, dim)
    forest = Forest(fitted, top, max(8, int(LEAF * len(fitted) / max(1, n))), trees)
    probes = probes_for(forest, fitted[:bound], recall, k)
    given = spark.sparkContext.broadcast(forest)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(-1, dim)
                leaves = given.value.assign(x)
                at = pa.array(np.repeat(np.arange(len(x)), leaves.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "id", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(-1, dim)
            found = given.value.search(x, probes)
            at = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([leaf for f in found for leaf in f], pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "id", "vec"])

    rows = base.select("vec_id", "vec").mapInArrow(index, "leaf long, id long, vec binary")
    asked = base.where(is_query).select("vec_id", "vec").mapInArrow(probe, "leaf long, id long, vec binary")
    chunks = lambda df, most: {r[0]: -(-r[1] // most) for r in df.groupBy("leaf").count().where(F.col("count") > most).collect()}  # noqa: E731  at most one row for each leaf
    many_rows, many_queries = chunks(rows, LEAF_ROWS), chunks(asked, LEAF_QUERIES)

    def times(which: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x).cast("long") for kv in which.items() for x in kv])[F.col("leaf")], F.lit(1).cast("long")) if which else F.lit(1).cast("long")

    b, c = times(many_rows), times(many_queries)
    spread = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), of - 1))
    own = lambda of: F.pmod(F.xxhash64("id"), of)
    rows = rows.select("leaf", own(b).alias("b"), spread(c).alias("c"), F.lit(False).alias("q"), "id", "vec")
    asked = asked.select("leaf", spread(b).alias("b"), own(c).alias("c"), F.lit(True).alias("q"), "id", "vec")
    group = F.xxhash64(F.expr(f"leaf div {LEAF_GROUP}"), "b", "c").alias("group")  # leaves that lie together share a task, which merges what they find
    dealt = rows.unionByName(asked).select(group, F.xxhash64("leaf", "b", "c").alias("part"), "q", "id", "vec")
    near = dealt.repartition("group").sortWithinPartitions("group", "part", "q").drop("group").mapInArrow(lambda it: _rerank(it, kind, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
