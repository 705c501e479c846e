"""Streaming forms: the state machine with per-key state, the generation ring, and event-time windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.machine import EFFECT, Graph, Machine, effect_rows

_COLUMNS = [x.split()[0] for x in EFFECT.split(", ")]


def run_stream(inputs: DataFrame, graph: Graph) -> DataFrame:
    """Effects of a stream of inputs (key, seq, kind, value, ready): the same rows as ``operators.machine.run`` gives.

    A micro-batch holds a key's inputs in any order; they are taken by seq. Inputs of later batches must follow."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = Machine(graph, json.loads(state.get[0]) if state.exists else None)
        rows = [r for part in parts for r in part[["seq", "kind", "value", "ready"]].itertuples(index=False)]
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: r.seq):
            value = None if pd.isna(r.value) else r.value
            ready = None if pd.isna(r.ready) else bool(r.ready)
            out += effect_rows(key[0], r.seq, machine.apply(r.kind, value, ready))
        state.update((json.dumps(machine.s),))
        frame = pd.DataFrame(out, columns=_COLUMNS)
        yield frame.astype({"key": "int64", "seq": "int64", "pos": "int32", "sequence": "Int64"})

    return inputs.groupBy("key").applyInPandasWithState(work, EFFECT, "state string", "append", "NoTimeout")


def ring_stream(rows: DataFrame, capacity: int) -> DataFrame:
    """A bounded, generation-stamped queue per key over rows (key, seq, op put|take|next, generation, item).

    Older generations are dropped and counted as stale, newer ones and a full ring are errors, an empty take is an underflow;
    next opens a generation and empties the ring. One row (key, seq, result, item) per input."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = json.loads(state.get[0]) if state.exists else {"generation": 0, "items": []}
        out = []
        for r in sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.seq):
            out.append((key[0], r.seq, *ring_step(ring, r.op, r.generation, None if pd.isna(r.item) else r.item, capacity)))
        state.update((json.dumps(ring),))
        yield pd.DataFrame(out, columns=["key", "seq", "result", "item"])

    return rows.groupBy("key").applyInPandasWithState(work, "key long, seq long, result string, item string", "state string", "append", "NoTimeout")


def ring_step(ring: dict, op: str, generation: int, item: str | None, capacity: int) -> tuple[str, str | None]:
    if op == "next":
        ring["generation"], ring["items"] = ring["generation"] + 1, []
        return "opened", None
    if op == "take":
        return ("taken", ring["items"].pop(0)) if ring["items"] else ("underflow", None)
    if generation < ring["generation"]:
        return "stale", item
    if generation > ring["generation"]:
        return "future", item
    if len(ring["items"]) >= capacity:
        return "full", item
    ring["items"].append(item)
    return "stored", item


def windowed_counts(events: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Tumbling counts and sums per event type over ``ts`` with a watermark: rows later than ``lateness`` are dropped by Spark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
