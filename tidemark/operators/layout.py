"""Ordinals, aligned offsets and spans over a total order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import tables


def prefix_sum(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in the total order (key, order), nulls first.

    Rows are dealt to ranges of that order which Spark draws from a sample, so neither an outlying key nor one with very many rows
    fills a task; the ranges are written, as a second sample could draw others (``ranges``: how many; else Spark decides). One row a range goes through one task, and rows
    are summed within their range."""
    cut = df.withColumn("_v", value).repartitionByRange(*([ranges] if ranges else []), key, *order).withColumn("_b", F.spark_partition_id())
    cut = tables.written(cut, "ranges")
    totals = cut.groupBy("_b").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_b", before.alias("_o"))  # one row for each range
    inner = F.coalesce(F.sum("_v").over(W.partitionBy("_b").orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(offsets), "_b").withColumn(name, (F.col("_o") + inner).cast("long")).drop("_b", "_v", "_o")


def decode_groups(rows: DataFrame, keys: Sequence[str], position: str, frame: str) -> DataFrame:
    """Numbers the smallest decode prefixes whose frames (0..n-1 in each key, unique) are contiguous."""
    w = W.partitionBy(*keys).orderBy(position)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    closed = rows.withColumn("_c", (F.max(frame).over(upto) + 1 == F.count(frame).over(upto)).cast("int"))
    return closed.withColumn("group", F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")


def reorder_depth(rows: DataFrame, keys: Sequence[str], position: str, frame: str) -> DataFrame:
    """Per key the most frames that wait for an earlier one: decoded so far less the contiguous prefix."""
    w = W.partitionBy(*keys)
    upto = w.orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    # the prefix that is complete after position p ends before the first frame decoded later than p
    later = F.min(frame).over(w.orderBy(position).rowsBetween(1, W.unboundedFollowing))
    return rows.withColumn("_d", F.count(frame).over(upto) - F.coalesce(later, F.count(frame).over(upto))).groupBy(*keys).agg(F.max("_d").alias("depth"))
