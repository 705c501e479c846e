"""Evidence and resource ledgers: operation evidence, schedule alignment, admission, grants, reclamation, credit.

What is a running sum or a rank is a window; what depends on its own earlier decisions (alignment, admission,
reclamation) streams over rows sorted by key and order, one small state at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def folded(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, fresh: Callable[[], dict], step: Callable[[dict, tuple], tuple]) -> DataFrame:
    """One row out for each row in, by a fold over each key's rows in order: the keys, the order columns and ``out`` ('name kind, ...')."""
    names = [*keys, *order, *[c for c in columns if c not in keys and c not in order]]
    base = rows.select(*names)
    lead = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[: len(keys) + len(order)])
    n, k = len(keys) + len(order), len(keys)
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    outs = [c.split() for c in out.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[:k] != now:
                    now, state = row[:k], fresh()
                found.append(step(state, row[n - len(order) :]))
            cols = [pa.array([f[j] for f in found], kinds[kind]) for j, (_, kind) in enumerate(outs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], [*batch.schema.names[:n], *[o[0] for o in outs]])

    return base.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, f"{lead}, {out}")


def aligned(refreshes: DataFrame, keys: list[str], order: str, value: str, schedule: list[str]) -> DataFrame:
    """Aligns each key's observed values with a schedule: repeat, advance, skip, regression or identity (not in it at all), and the place after it."""
    place: dict[str, list[int]] = {}
    for k, v in enumerate(schedule):
        place.setdefault(v, []).append(k)

    def step(state: dict, row: tuple) -> tuple:
        at, own = state["at"], place.get(row[1], [])
        if at >= 0 and schedule[at] == row[1]:
            return "repeat", at
        later = next((k for k in own if k > at), None)
        if later is not None:
            state["at"] = later
            return ("advance" if later == at + 1 else "skip"), later
        return ("regression" if any(k < at for k in own) else "identity"), at

    return folded(refreshes, keys, [order], [value], "verdict string, place long", lambda: {"at": -1}, step)


def admitted(requests: DataFrame, keys: list[str], order: str, amount: str, limit: int) -> DataFrame:
    """Byte admission in order: a request that would exceed ``limit`` is refused and takes nothing; negative amounts give back."""

    def step(state: dict, row: tuple) -> tuple:
        after = state["held"] + row[1]
        ok = after <= limit
        state["held"] = max(0, after) if ok else state["held"]
        return ok, state["held"]

    return folded(requests, keys, [order], [amount], "ok boolean, held long", lambda: {"held": 0}, step)


def granted(tickets: DataFrame, keys: list[str], order: str, hidden: str, stale: str, free: int) -> DataFrame:
    """First come, first served: stale tickets are cancelled, hidden ones parked, and ``free`` of the others granted."""
    live = ~F.col(hidden) & ~F.col(stale)
    turn = F.sum(live.cast("long")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    # the queue is looked at until the free places are taken; what stands behind stays queued
    taken = F.coalesce(F.sum(live.cast("long")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    verdict = F.when(taken >= free, "queued").when(F.col(stale), "cancelled").when(F.col(hidden), "parked").when(turn <= free, "granted").otherwise("queued")
    return tickets.withColumn("verdict", verdict)


def reclaimed(candidates: DataFrame, keys: list[str], order: list[str], amount: str, shortfall: int) -> DataFrame:
    """Victims in order until the shortfall is covered, each giving min(what it has, what is still short); none at all where all together do not cover it."""
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum(amount).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    enough = F.sum(amount).over(w) >= shortfall
    asked = F.least(F.col(amount), F.greatest(F.lit(0), F.lit(shortfall) - before))
    return candidates.withColumn("asked", F.when(enough, asked).otherwise(F.lit(0)).cast("long")).where("asked > 0")


def operation_failures(inputs: DataFrame, requests: DataFrame, settlements: DataFrame) -> DataFrame:
    """(key, op, code): inputs (key, op, at, target) against the request evidence (key, op, target) and settlements (key, op, at)."""
    both = inputs.join(requests.select("key", "op", F.col("target").alias("asked")), ["key", "op"], "left").join(settlements.select("key", "op", F.col("at").alias("done")), ["key", "op"], "left")
    codes = F.array_compact(F.array(F.when(~F.col("asked").eqNullSafe(F.col("target")), "request-evidence"), F.when(F.col("done").isNull() | (F.col("done") < F.col("at")), "settlement-order")))
    orphans = settlements.join(inputs, ["key", "op"], "left_anti").select("key", "op", F.lit("settlement-without-input").alias("code"))
    return both.select("key", "op", F.explode(codes).alias("code")).unionByName(orphans)


def frame_credit(ops: DataFrame, keys: list[str], order: str, op: str, amount: str, most_bytes: int, most_frames: int) -> DataFrame:
    """Decoded frames that are lent out: (keys, order, outcome, frame, count, bytes) for each operation.

    ``lease`` lends a frame of ``amount`` bytes under the next number unless the bytes lent would exceed ``most_bytes``; ``release`` takes back
    frame ``amount``; ``clear`` takes back all; ``submit`` asks whether ``amount`` submitted frames and those lent leave room for one more."""

    def step(state: dict, row: tuple) -> tuple:
        held, what, n = state["held"], row[1], row[2]
        frame = None
        if what == "lease":
            outcome = "budget-exceeded"
            if state["bytes"] + n <= most_bytes:
                outcome, frame = "leased", state["next"]
                held[frame] = n
                state["next"], state["bytes"] = frame + 1, state["bytes"] + n
        elif what == "release":
            outcome = "released" if n in held else "release-invalid"
            state["bytes"] -= held.pop(n, 0)
        elif what == "clear":
            outcome = "cleared"
            held.clear()
            state["bytes"] = 0
        else:
            outcome = "credit" if n + len(held) < most_frames else "no-credit"
        return outcome, frame, len(held), state["bytes"]

    return folded(ops, keys, [order], [op, amount], "outcome string, frame long, count long, bytes long", lambda: {"held": {}, "next": 1, "bytes": 0}, step)


def page_admission(requests: DataFrame, keys: list[str], order: str, player: str, amount: str, player_limit: int, page_limit: int) -> DataFrame:
    """Byte admission with a limit a player and one a page (``keys``): (keys, order, outcome, player_bytes, page_bytes).

    A request is granted if both sums stay within their limits, else it takes nothing; a null amount disposes of the player, who gives back all."""

    def step(state: dict, row: tuple) -> tuple:
        own, total = state.get(row[1], 0), sum(state.values())
        if row[2] is None:
            state.pop(row[1], None)
            return "disposed", 0, total - own
        if own + row[2] > player_limit or total + row[2] > page_limit:
            return "rejected", own, total
        state[row[1]] = own + row[2]
        return "reserved", own + row[2], total + row[2]

    return folded(requests, keys, [order], [player, amount], "outcome string, player_bytes long, page_bytes long", dict, step)
