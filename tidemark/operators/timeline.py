"""As-of joins, hold resampling, gaps, islands and cyclic portals, without theta joins.

As-of joins are a union of both sides and one window over the time order: a shuffle by key, no
nested loop. Ties are broken by the given columns, sources before probes (backward) or after (forward)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _union(probes: DataFrame, sources: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], tie: str) -> DataFrame:
    p = probes.withColumn("_source", F.lit(None).cast(sources.select(F.struct(*[F.col(c) for c in payload])).schema[0].dataType)).withColumn("_kind", F.lit(1))
    keep = [F.col(c) if c in keys or c == at else F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns]
    s = sources.select(*keep, F.struct(*[F.col(c) for c in payload]).alias("_source"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"))
    return p.withColumn("_tie", F.lit(None).cast(sources.schema[tie].dataType)).unionByName(s)


def as_of(probes: DataFrame, sources: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str], tie: str, forward: bool = False, band: int | None = None) -> DataFrame:
    """Each probe with a struct ``_source``: the latest source at or before it, or the first at or after it (null if none).

    With ``band`` a task holds a key's rows within that width of ``at`` and not all of them: what earlier (later) bands hand
    over is one row a band, by an aggregation that combines before it shuffles."""
    both = _union(probes, sources, keys, at, payload, tie)
    if band:
        keys = [*keys, "_band"]
        both = both.withColumn("_band", F.floor(F.col(at) / band).cast("long"))
        both = both.unionByName(_handed_over(both, keys, at, band, forward), allowMissingColumns=True)
    w = W.partitionBy(*keys)
    if forward:
        order = w.orderBy(F.col(at), F.col("_kind").desc(), F.col("_tie")).rowsBetween(0, W.unboundedFollowing)
        found = F.first("_source", ignorenulls=True).over(order)
    else:
        order = w.orderBy(F.col(at), F.col("_kind"), F.col("_tie")).rowsBetween(W.unboundedPreceding, 0)
        found = F.last("_source", ignorenulls=True).over(order)
    return both.withColumn("_source", found).where("_kind = 1").drop("_kind", "_tie", "_band")


def _handed_over(both: DataFrame, keys: list[str], at: str, band: int, forward: bool) -> DataFrame:
    """For each band the source that an earlier (later) band ends (begins) with, at this band's own edge."""
    spot = F.when(F.col("_kind") == 0, F.struct(at, "_tie"))
    end = (F.min_by if forward else F.max_by)("_source", spot)
    per = both.groupBy(*keys).agg(end.alias("_end"))
    w = W.partitionBy(*keys[:-1]).orderBy("_band")
    carried = F.first("_end", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)) if forward else F.last("_end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    edge = (F.col("_band") + (1 if forward else 0)) * band
    return per.withColumn("_source", carried).where("_source IS NOT NULL").select(*keys, "_source", edge.cast(both.schema[at].dataType).alias(at), F.lit(-1).alias("_kind"))


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "gap") -> DataFrame:
    """Difference to the previous row of the key; null on the first."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, value - F.lag(value).over(w))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows; a row where ``breaks`` holds begins a new one."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def merged_ranges(ranges: DataFrame, keys: Sequence[str], start: str = "off", length: str = "len") -> DataFrame:
    """Adjacent half-open ranges as one: keys, start, end, parts."""
    end = F.col(start) + F.col(length)
    w = W.partitionBy(*keys).orderBy(start)
    marked = islands(ranges, keys, [start], F.coalesce(F.lag(end).over(w) != F.col(start), F.lit(True)))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def split_ranges(ranges: DataFrame, target: int) -> DataFrame:
    """Ranges (start, end) cut into requests of at most ``target``."""
    at = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(target).cast("long")))
    return ranges.where("end > start").withColumn("first", at).withColumn("last", F.least(F.col("first") + target, F.col("end"))).drop("start", "end")


def portal_boundary(portals: Column, frame: Column, count: int | Column) -> tuple[Column, Column]:
    """(boundary, wait) to the next portal at or after ``frame`` of a loop, else the first one a lap later. ``portals``: sorted array."""
    after = F.array_min(F.filter(portals, lambda p: p >= frame))
    boundary = F.coalesce(after, F.array_min(portals) + count)
    return boundary, boundary - frame


def greatest_wait(portals: Column, count: int | Column) -> Column:
    """Longest wait for a portal of a loop: the largest circular gap less one."""
    ring = F.concat(portals, F.array(F.array_min(portals) + count))
    gap = F.transform(F.slice(ring, 2, F.size(portals)), lambda p, i: p - F.element_at(ring, i + 1))
    return F.array_max(gap) - 1


def greatest_wait_finite(portals: Column) -> Column:
    """Longest wait for a portal of a finite body that is entered at 0: the first portal, or the largest gap less one."""
    gap = F.transform(F.slice(portals, 2, F.greatest(F.size(portals) - 1, F.lit(0))), lambda p, i: p - F.element_at(portals, i + 1) - 1)
    return F.greatest(F.array_min(portals), F.coalesce(F.array_max(gap), F.lit(0)))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given (falling) order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def counted_upto(probes: DataFrame, sources: DataFrame, keys: Sequence[str], at: str, name: str = "upto") -> DataFrame:
    """Each probe with the number of sources of its key at or before it."""
    both = probes.withColumn("_kind", F.lit(1)).unionByName(sources.select(*keys, at).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    upto = W.partitionBy(*keys).orderBy(at, "_kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.sum(1 - F.col("_kind")).over(upto)).where("_kind = 1").drop("_kind")


def exact_grid(frames: DataFrame, keys: Sequence[str], order: Sequence[str], ticks: str, duration: str, rate: tuple[int, int], base: tuple[int, int]) -> DataFrame:
    """(keys, frames, exact): whether each frame stands and lasts exactly as the rate says, in ticks of the time base; by cross multiplication."""
    w = W.partitionBy(*keys).orderBy(*order)
    wide = lambda c: c.cast("decimal(38,0)")
    scale, step = (F.lit(a * b).cast("decimal(20,0)") for a, b in ((rate[0], base[0]), (rate[1], base[1])))
    i, first = F.row_number().over(w) - 1, F.first(ticks).over(w)
    fits = (wide((F.col(ticks) - first) * scale) == wide(i * step)) & (wide(F.col(duration) * scale) == wide(step))
    return frames.withColumn("_fits", fits).groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.bool_and("_fits").alias("exact"))
