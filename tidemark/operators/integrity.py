"""Referential integrity, coverage, positional agreement and use counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def foreign_key_violations(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, key, n): rows of (name, child, column, parent, column) whose non-null key has no parent."""
    parts = []
    for name, child, column, parent, of in checks:
        keys = child.select(F.col(column).cast("long").alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        parts.append(keys.join(parent.select(F.col(of).cast("long").alias("key")), "key", "left_anti").select(F.lit(name).alias("check"), "key", "n"))
    return reduce(DataFrame.unionByName, parts)


def missing(expected: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the expected grid that were not seen."""
    return expected.join(seen.select(*on).distinct(), list(on), "left_anti")


def use_counts(units: DataFrame, unit: str, uses: DataFrame, used: str, wanted: Column) -> DataFrame:
    """Units whose number of uses is not ``wanted``: (unit, uses)."""
    n = uses.groupBy(F.col(used).alias(unit)).agg(F.count(F.lit(1)).alias("uses"))
    return units.select(unit).join(n, unit, "left").select(unit, F.coalesce("uses", F.lit(0)).alias("uses")).where(F.col("uses") != wanted)


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Positions at which two logs of a key disagree or one has ended."""
    number = lambda df, name: df.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("pos"), F.col(value).alias(name))
    both = number(left, "left_value").join(number(right, "right_value"), [*keys, "pos"], "full")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def inverse_pairs(edges: DataFrame, unit: str, edge: str, source: str, target: str) -> DataFrame:
    """Units whose edges are exactly two, the second leading back along the first: (unit, a, b)."""
    two = edges.groupBy(unit).agg(F.sort_array(F.collect_list(F.struct(F.col(edge).alias("e"), F.col(source).alias("s"), F.col(target).alias("t")))).alias("es")).where(F.size("es") == 2)
    a, b = F.col("es")[0], F.col("es")[1]
    return two.where((a["s"] == b["t"]) & (a["t"] == b["s"])).select(unit, a["e"].alias("a"), b["e"].alias("b"))


def counters(baseline: DataFrame, terminal: DataFrame, name: str, value: str) -> DataFrame:
    """(name, baseline, terminal, delta); a counter that is missing on a side is 0 there."""
    side = lambda df, as_: df.select(name, F.col(value).alias(as_))
    both = side(baseline, "baseline").join(side(terminal, "terminal"), name, "full")
    zero = both.select(name, F.coalesce("baseline", F.lit(0)).alias("baseline"), F.coalesce("terminal", F.lit(0)).alias("terminal"))
    return zero.withColumn("delta", F.col("terminal") - F.col("baseline"))


def edge_failures(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(edge, code): the first rule that an edge breaks.

    ``edges``: edge, src, dst, start (portal, finish, cut), source_port, target_port, transition (locked, reversible or null), unit_kind, continuity.
    ``states``: state, playback (loop, finite, held), frames, ports array<struct<id, last>> with each port's last portal."""
    side = lambda name, key: states.select(F.col("state").alias(key), F.col("playback").alias(f"{name}_playback"), F.col("frames").alias(f"{name}_frames"), F.col("ports").alias(f"{name}_ports"))
    both = edges.join(side("s", "src"), "src", "left").join(side("t", "dst"), "dst", "left")
    port = F.try_element_at(F.filter("s_ports", lambda p: p["id"] == F.col("source_port")), F.lit(1))
    start, kind, exact = F.col("start"), F.col("transition"), F.col("continuity") == "exact-authored"
    code = (
        F.when(F.col("s_playback").isNull(), "from")
        .when(F.col("t_playback").isNull(), "to")
        .when(~F.exists("t_ports", lambda p: p["id"] == F.col("target_port")), "target-port")
        .when((start == "portal") & port.isNull(), "source-port")
        .when((start == "portal") & (F.col("s_playback") == "finite") & (port["last"] != F.col("s_frames") - 1), "held-frame")
        .when((start == "finish") & (F.col("s_playback") == "loop"), "finish-of-loop")
        .when((kind == "locked") & ~F.col("unit_kind").eqNullSafe("bridge"), "bridge-unit")
        .when((kind == "locked") & ~exact, "locked-continuity")
        .when((kind == "reversible") & ~F.col("unit_kind").eqNullSafe("reversible"), "reversible-unit")
        .when(kind.isNull() & (start != "cut") & ~exact, "continuity")
    )
    return both.select("edge", code.alias("code")).where("code IS NOT NULL")


def counter_failures(deltas: DataFrame, allowances: dict[str, int]) -> DataFrame:
    """(name, delta, allowed) of the counters (name, baseline, terminal, delta) that grew by more than allowed; nothing is allowed to those not named."""
    allowed = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in allowances.items()], F.lit(0))
    return deltas.withColumn("allowed", allowed.cast("long")).where("delta > allowed").select("name", "delta", "allowed")


def slot_matrix(profiles: DataFrame, required: DataFrame, platforms: Sequence[int], usual: int, conditional: int) -> DataFrame:
    """(code, platform, browser, refresh): slots of the required grid (platform, browser) that no profile fills, slots filled twice, profiles off the grid.

    Each platform needs the usual refresh rate and, where one of its profiles says it is available, the conditional one."""
    available = profiles.groupBy("platform").agg(F.bool_or("available").alias("more"))
    rates = F.when(F.col("more"), F.array(F.lit(usual), F.lit(conditional))).otherwise(F.array(F.lit(usual)))
    grid = required.join(available, "platform", "left").select("platform", "browser", F.explode(rates).alias("refresh"))
    slots = profiles.groupBy("platform", "browser", "refresh").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("available")).alias("not_available"))
    coded = lambda df, code: df.select(F.lit(code).alias("code"), "platform", "browser", F.col("refresh").cast("long").alias("refresh"))
    known = F.col("platform").isin(*platforms)
    return reduce(DataFrame.unionByName, [
        coded(missing(grid, slots, ["platform", "browser", "refresh"]), "missing"), coded(slots.where("n > 1"), "duplicate"), coded(slots.where(~known), "unknown-platform"),
        coded(slots.where(~F.col("refresh").isin(usual, conditional)), "unknown-refresh"), coded(slots.where((F.col("refresh") == conditional) & F.col("not_available")), "unavailable-refresh"),
    ])
