"""Sharding by k-d tree partitioning, in DataFrame functions alone.

A node with k shards to fill is split along the metadata dimension that is widest in it (relative to
the whole table) at the weighted quantile floor(k/2)/k of bytes, until each leaf is one shard and so
holds the target bytes. A level of the tree takes two passes over small cells, whatever its number of nodes: one
aggregation counts bytes per (node, dimension, bin), which shows what is widest and the bin with the quantile, and one
counts bytes per range of text hashes within that bin. The driver gets at most nodes x dimensions x ``BINS`` sums.
No node is ever gathered in a task.

The order along a dimension is (value, up to the bin of the quantile; within it text hash, row number), so it is total even
where a third of all rows share one source. Equal texts form a group; metadata of a group is the least of its rows'.
A group moves as a whole unless it weighs more than ``WHOLE`` of a shard; such a group may be cut
between any two of its rows, repeated rows included, for sizes to stay near equal. At most shards / ``WHOLE`` groups weigh that much.

Slots number a shard's rows from 0 without gaps: rows are counted per (shard, bucket), buckets get
offsets, and row numbers are taken within buckets, so no task sorts a whole shard.

Defined cases: null text has no bytes and the size ``OVERHEAD``; its crc32 is that of no bytes; null
metadata counts as -1; repeated rows are rows of their own; no rows give no rows. Columns
other than doc_id, text and the metadata named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

SHARDS = 40
OVERHEAD = 16
BINS = 512
HASH_BINS = 4096
WHOLE = 0.04
CLOSE = 0.0005
BUCKET_ROWS = 100_000
MOST_BUCKETS = 4096
HASH_TOP = (1 << 62) - 1


@dataclass
class Node:
    """A leaf (``left`` is None) or a split. Left go values below ``lo``, and of those up to ``hi`` the ones whose (text hash, row hash) is below (g, r)."""

    shards: int
    first: int
    box: list[tuple[int, int]]
    key: int = 0
    dim: int = 0
    lo: int = 0
    hi: int = -1
    g: int = 0
    r: int = 0
    left: Node | None = None
    right: Node | None = None

    def split(self, at_g: int = 0, at_r: int = 0) -> None:
        self.g, self.r = at_g, at_r
        half = self.shards // 2
        low, high = list(self.box), list(self.box)
        if self.box:
            a, b = self.box[self.dim]
            low[self.dim], high[self.dim] = (a, min(b, max(self.lo - 1, self.hi))), (max(a, self.lo), b)
        self.left, self.right = Node(half, self.first, low), Node(self.shards - half, self.first + half, high)


@dataclass
class Search:
    """Where within a bin a node's quantile is: a range of text hashes or, for one text that weighs much, of row hashes."""

    node: Node
    aim: float
    below: float
    lo: int = 0
    hi: int = HASH_TOP
    text: int | None = None


def _metadata(docs: DataFrame, metadata: Sequence[str]) -> list[Column]:
    """Each dimension as a long: integers as they are, all else by a 16-bit hash of its text."""
    out = []
    for name in metadata:
        whole = dict(docs.dtypes)[name] in ("bigint", "int", "smallint", "tinyint")
        value = docs[name].cast("long") if whole else F.crc32(docs[name].cast("string").cast("binary")).bitwiseAND(F.lit(0xFFFF).cast("long"))
        out.append(F.coalesce(value, F.lit(-1).cast("long")))
    return out


def _nodes(node: Node) -> list[Node]:
    return [node] + ([] if node.left is None else _nodes(node.left) + _nodes(node.right))


def _depth(node: Node) -> int:
    return 0 if node.left is None else 1 + max(_depth(node.left), _depth(node.right))


def _given(spark: SparkSession, names: str, rows: Sequence[tuple]) -> DataFrame:
    """A few rows of longs per node of the tree, to be broadcast: at most nodes x dimensions."""
    cols = names.split()
    values = ", ".join(f"({', '.join(map(str, row))})" for row in rows)
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)
    return F.broadcast(spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(cols)})"))


def routed(cells: DataFrame, root: Node) -> DataFrame:
    """Sets node, 0 before, to the key of the leaf that a row (dims array, g, r, node) belongs to."""
    nodes = _nodes(root)
    for k, n in enumerate(nodes):
        n.key = k
    out = cells
    splits = [(n.key, n.dim, n.lo, n.hi, n.g, n.r, n.left.key, n.right.key) for n in nodes if n.left is not None]
    if not splits:
        return out
    given = _given(common.session(cells), "k_node k_dim k_lo k_hi k_g k_r k_left k_right", splits)
    v = F.element_at("dims", (F.col("k_dim") + 1).cast("int"))
    below = (v < F.col("k_lo")) | ((v <= F.col("k_hi")) & ((F.col("g") < F.col("k_g")) | ((F.col("g") == F.col("k_g")) & (F.col("r") < F.col("k_r")))))
    for _ in range(_depth(root)):
        now = F.when(F.col("k_node").isNull(), F.col("node")).when(below, F.col("k_left")).otherwise(F.col("k_right"))
        out = out.join(given, F.col("node") == F.col("k_node"), "left").select(*[c for c in out.columns if c != "node"], now.alias("node"))
    return out


def _crossing(sums: list[tuple], aim: float, run: float) -> tuple[float, tuple]:
    """Of (bin, bytes, cells, least, greatest) the one within which ``aim`` lies, and the bytes before it."""
    at = None
    for at in sorted(sums):
        if run + at[1] >= aim:
            break
        run += at[1]
    else:
        run -= at[1]
    return run, at


def _begin(placed: DataFrame, todo: list[Node], span: list[int], close: float) -> list[Search]:
    """The first pass of a level: picks each node's dimension and the bin with its quantile; gives back the nodes that need the second."""
    step = lambda a, b: max(1, -(-(b - a + 1) // BINS))
    rows = [(n.key, d, a, step(a, b)) for n in todo for d, (a, b) in enumerate(n.box)]
    v = F.element_at("dims", (F.col("k_dim") + 1).cast("int"))
    met = placed.join(_given(common.session(placed), "k_node k_dim k_lo k_width", rows), F.col("node") == F.col("k_node")).select("node", F.col("k_dim").alias("dim"), F.call_function("div", v - F.col("k_lo"), F.col("k_width")).alias("bin"), "w", v.alias("v"))
    found: dict[int, dict[int, list[tuple]]] = {n.key: {} for n in todo}
    for node, dim, *rest in met.groupBy("node", "dim", "bin").agg(F.sum("w"), F.count(F.lit(1)), F.min("v"), F.max("v")).collect():
        found[node].setdefault(dim, []).append(tuple(rest))
    out = []
    for n in todo:
        sums = found[n.key]
        if not sums:
            n.split()
            continue
        n.dim = max(sorted(sums), key=lambda d: (max(x[4] for x in sums[d]) - min(x[3] for x in sums[d])) / span[d])
        aim = sum(x[1] for x in sums[n.dim]) * (n.shards // 2) / n.shards
        run, (_, weight, cells, low, high) = _crossing(sums[n.dim], aim, 0)
        n.lo, n.hi = low, high
        if weight <= close or cells == 1:
            n.lo, n.hi = (high + 1, high) if 2 * (aim - run) >= weight else (low, low - 1)
            n.split()
        else:
            out.append(Search(n, aim, run))
    return out


def _narrow(placed: DataFrame, todo: list[Search], close: float) -> list[Search]:
    """The second pass: steps into the range of hashes with each node's quantile; gives back the nodes whose range is still too heavy."""
    by = {s.node.key: s for s in todo}
    rows = [(k, s.node.dim, s.node.lo, s.node.hi, -1 if s.text is None else s.text, s.lo, s.hi, max(1, -(-(s.hi - s.lo + 1) // HASH_BINS))) for k, s in by.items()]
    v = F.element_at("dims", (F.col("k_dim") + 1).cast("int"))
    key = F.when(F.col("k_text") < 0, F.col("g")).otherwise(F.col("r"))
    met = placed.join(_given(common.session(placed), "k_node k_dim k_lo k_hi k_text k_first k_last k_width", rows), F.col("node") == F.col("k_node"))
    met = met.where(v.between(F.col("k_lo"), F.col("k_hi")) & ((F.col("k_text") < 0) | (F.col("g") == F.col("k_text")))).withColumn("key", key).where("key BETWEEN k_first AND k_last")
    found: dict[int, list[tuple]] = {k: [] for k in by}
    for node, *rest in met.select("node", F.expr("(key - k_first) div k_width").alias("bin"), "w", "key").groupBy("node", "bin").agg(F.sum("w"), F.count(F.lit(1)), F.min("key"), F.max("key")).collect():
        found[node].append(tuple(rest))
    out = []
    for k, s in by.items():
        s.below, (_, weight, cells, low, high) = _crossing(found[k], s.aim, s.below)
        if weight <= close or cells == 1 or (low == high and s.text is not None):
            cut = high + 1 if 2 * (s.aim - s.below) >= weight else low
            s.node.split(*((cut, 0) if s.text is None else (s.text, cut)))
            continue
        if low == high:
            s.text, low, high = low, 0, HASH_TOP
        s.lo, s.hi = low, high
        out.append(s)
    return out


def grow(cells: DataFrame, box: list[tuple[int, int]], weight: float, shards: int) -> Node:
    """The tree over ``cells``: dims (array), g, r, w (bytes); ``box`` bounds the dimensions, ``weight`` is the sum of w."""
    root = Node(shards, 0, box)
    span, close = [max(1, b - a) for a, b in box], CLOSE * weight / shards
    while level := [n for n in _nodes(root) if n.left is None and n.shards > 1]:
        placed = routed(cells, root)
        todo = _begin(placed, level, span, close)
        while todo:
            todo = _narrow(placed, todo, close)
    return root


def kd_shards(docs: DataFrame, shards: int = SHARDS, metadata: Sequence[str] = ("n_chars", "source", "lang", "doc_id")) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``."""
    text = docs["text"].cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    dims = _metadata(docs, [m for m in metadata if m in docs.columns]) or [size]
    spread = lambda c: F.shiftrightunsigned(c, 2)
    names = [f"m{k}" for k in range(len(dims))]
    rows = common.written(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), size.alias("w"), F.crc32(F.coalesce(text, F.lit(b""))).alias("crc"),
        spread(F.xxhash64(text)).alias("g"), spread(F.xxhash64(F.monotonically_increasing_id())).alias("r"), *[c.alias(m) for m, c in zip(names, dims, strict=True)],
    ), "shard-rows")
    n, total, *ends = rows.agg(F.count(F.lit(1)), F.sum("w"), *[f(m) for m in names for f in (F.min, F.max)]).first()
    heavy = WHOLE * (total or 0) / shards
    grouped = rows.groupBy("g").agg(F.sum("w").alias("w"), *[F.min(m).alias(m) for m in names])
    groups = common.written(grouped.select("g", "w", F.array(*names).alias("dims")), "shard-groups")
    few = groups.where(F.col("w") > heavy).select("g", "dims")  # shards / WHOLE rows at most
    own = rows.join(F.broadcast(few), "g").select("g", "r", "w", "dims", "doc_id", "crc")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    whole = groups.where(F.col("w") <= heavy).select("g", zero.alias("r"), "w", "dims", none.alias("doc_id"), none.alias("crc"))
    cells = common.written(whole.withColumn("single", F.lit(False)).unionByName(own.withColumn("single", F.lit(True))).withColumn("node", zero), "shard-cells")
    common.removed(groups)
    box = list(zip(ends[::2], ends[1::2], strict=True)) if n else [(0, 0)] * len(names)
    tree = grow(cells, box, total or 0, shards)

    placed = routed(cells, tree)
    leaves = _given(common.session(docs), "k_leaf k_shard", [(x.key, x.first) for x in _nodes(tree) if x.left is None])
    placed = placed.join(leaves, F.col("node") == F.col("k_leaf")).withColumn("shard", F.col("k_shard").cast("int"))
    # rows of heavy texts are placed as they are; all others take their text's shard, and no text is a hot key
    singles = placed.where("single").select("doc_id", F.col("w").alias("size"), F.col("crc").alias("text_crc32"), "r", "shard")
    of = placed.where("NOT single").select("g", "shard")
    others = rows.join(of, "g").select("doc_id", F.col("w").alias("size"), F.col("crc").alias("text_crc32"), "r", "shard")
    out = common.written(singles.unionByName(others), "shard-placed")
    common.removed(rows, cells)
    return numbered(out, n, shards)


def numbered(placed: DataFrame, n: int, shards: int) -> DataFrame:
    """Adds slot: gapless numbers within each shard. ``r`` is a hash of the row's own number."""
    buckets = max(1, min(MOST_BUCKETS, -(-n // (shards * BUCKET_ROWS))))
    keyed = placed.withColumn("bucket", F.pmod(F.col("r"), F.lit(buckets)))
    sizes = keyed.groupBy("shard", "bucket").count()
    # at most shards x MOST_BUCKETS rows
    offsets = sizes.withColumn("base", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("count")
    order = W.partitionBy("shard", "bucket").orderBy("doc_id", "r")
    return keyed.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("slot", F.col("base") + F.row_number().over(order) - 1).select("doc_id", "size", "text_crc32", "shard", "slot")
