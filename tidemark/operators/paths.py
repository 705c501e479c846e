"""Recursive and dynamic-programming operators: completion cycles, reachability, heaviest decode windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables

#: Hops of a closure that one job takes.
HOPS = 6


def functional_cycles(edges: DataFrame, nodes: int) -> DataFrame:
    """(node): nodes on cycles of a graph (src, dst) with out-degree one at most and ``nodes`` nodes or fewer.

    Pointer doubling: after 2^k >= nodes steps every walk that has not ended stands on a cycle, and each node of
    a cycle is where some walk stands."""
    walk = tables.written(edges.select("src", "dst"), "walk")
    for _ in range(max(1, nodes.bit_length())):
        walk = tables.written(walk.alias("a").join(walk.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")), "walk")
    return walk.select(F.col("dst").alias("node")).distinct()


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node): what ``roots`` (node) reach over (src, dst) in at most ``depth`` steps, themselves included."""
    seen = front = roots.select("node").distinct()
    for _ in range(depth):
        front = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, roots: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node): all that ``roots`` (node) reach over (src, dst), themselves included; ends when a round finds nothing new.

    A round takes ``hops`` hops in one job, so a deep graph needs depth / hops jobs; what is first met at the last of them
    is where the next round begins."""
    edges = tables.written(edges.select("src", "dst").distinct(), "edges")
    seen = front = tables.written(roots.select("node").distinct(), "seen")
    while not front.isEmpty():
        at, met = front, []
        for hop in range(1, hops + 1):
            at = at.join(edges, at["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
            met.append(at.withColumn("hop", F.lit(hop)))
        found = reduce(DataFrame.unionByName, met).groupBy("node").agg(F.min("hop").alias("hop"))
        new = tables.written(found.join(seen, "node", "left_anti"), "front")
        front = new.where(F.col("hop") == hops).select("node")
        seen = seen.unionByName(new.select("node"))
    return seen


def heaviest_window(units: dict[str, list[tuple[int, int]]], after: dict[str, list[str]], limit: int) -> int:
    """Most bytes on a decode path that shows at most ``limit`` frames.

    ``units``: (bytes, frames) of each chunk; a path may begin anywhere and goes on from a unit's end to the
    units ``after`` it. Chunks without frames cost bytes only; every unit shows a frame, so paths end."""
    if any(not any(f for _, f in chunks) for chunks in units.values()):
        raise ValueError("a unit shows no frame")

    @cache
    def entered(unit: str, left: int) -> int:
        return best(unit, 0, left)

    def best(unit: str, at: int, left: int) -> int:
        total = most = 0
        for size, frames in units[unit][at:]:
            if frames > left:
                return most
            total, left = total + size, left - frames
            most = max(most, total)
        return max([most, *(total + entered(v, left) for v in after.get(unit, ()))])

    return max((best(u, k, limit) for u, chunks in units.items() for k in range(len(chunks))), default=0)


def heaviest_windows(assets: DataFrame, limit: int) -> DataFrame:
    """(asset, window_bytes) for rows (asset, units array<struct<id, chunks array<struct<bytes, frames>>, after array<string>>>); an asset is one row, as the format bounds it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for units in batch.column(1).to_pylist():
                chunks = {u["id"]: [(c["bytes"], c["frames"]) for c in u["chunks"]] for u in units}
                out.append(heaviest_window(chunks, {u["id"]: u["after"] for u in units}, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["asset", "window_bytes"])

    return assets.select(F.col("asset").cast("long").alias("asset"), "units").mapInArrow(work, "asset long, window_bytes long")
