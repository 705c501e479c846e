"""Exact nearest-rank statistics.

``percentile_disc`` keeps every distinct value of a group in memory. That is right for many small groups
(``nearest_rank``). For few groups of unbounded size ``bracketed_rank`` asks a mergeable sketch for a bracket that is
sure to hold the rank, counts what lies below it and selects exactly among the rows inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ACCURACY = 10_000


def nearest_rank(value: str, fraction: float, empty: float | None = None) -> Column:
    """The smallest value with at least ``fraction`` of the rows at or below it; ``empty`` where there is none."""
    found = F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")
    return found if empty is None else F.coalesce(found, F.lit(empty))


def summary(value: str) -> list[Column]:
    """Benchmark summary of a group: count, min, max, median, p95 and p99, all by nearest rank."""
    v = F.col(value)
    return [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), *(nearest_rank(value, p).alias(name) for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)))]


def bracketed_rank(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: the keys, n, min, max and the nearest-rank value of each named fraction."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    step = 2.0 / accuracy
    cuts = [c for p in fractions.values() for c in (max(0.0, p - step), min(1.0, p + step))]
    sketch = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.percentile_approx("_v", cuts, accuracy).alias("_b"))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) - F.lit(1e-9))).cast("long").alias("rank"), F.when(F.lit(p <= step), F.col("min")).otherwise(F.col("_b")[2 * k]).alias("lo"), F.when(F.lit(p >= 1 - step), F.col("max")).otherwise(F.col("_b")[2 * k + 1]).alias("hi")) for k, (name, p) in enumerate(fractions.items())])
    wide = sketch.select(*keys, "n", "min", "max", spots.alias("_spots"))
    # per row and fraction: below the bracket (a count), inside (kept), above (dropped)
    joined = rows.join(wide.select(*keys, "_spots"), list(keys)) if keys else rows.crossJoin(F.broadcast(wide.select("_spots")))
    placed = joined.select(*keys, "_v", F.explode("_spots").alias("s")).where(F.col("_v") <= F.col("s.hi"))
    inside = placed.select(*keys, F.col("s.name").alias("name"), F.col("s.rank").alias("rank"), F.when(F.col("_v") >= F.col("s.lo"), F.col("_v")).alias("_v"))
    counted = inside.groupBy(*keys, "name", "rank", "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    found = counted.withColumn("u", upto).where("u >= rank AND _v IS NOT NULL").groupBy(*keys, "name").agg(F.min("_v").alias("_v"))
    wide_found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in fractions])
    base = wide.drop("_spots")
    return base.join(wide_found, list(keys)) if keys else base.crossJoin(wide_found)
