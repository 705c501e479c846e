"""What the training-data operators share: session settings, shared tables, text batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path, removed, shared_dir  # noqa: F401  the operators take them from here
from ..tables import written as _written

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 512

#: Spark's default size of Arrow batches, and what texts get instead: batches are held several
#: times over (JVM, Python, the way back), and texts are long.
SMALLER = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
}


def session(df: DataFrame) -> SparkSession:
    """The session; where its Arrow batches still have the default size, they are made smaller."""
    spark = df.sparkSession
    for key, (default, smaller) in SMALLER.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, smaller)
    return spark


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``tables.written`` with batches for long texts."""
    session(df)
    return _written(df, name, **options)


def carried(df: DataFrame, columns: Sequence[str]) -> Column:
    """The named columns as one struct, so that their names cannot clash with an operator's own."""
    cols = [df[c].alias(c) for c in columns] or [F.lit(None).cast("int").alias("_none")]
    return F.struct(*cols)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; ``bytes.lower`` and ``bytes.split`` then touch ASCII alone."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc_mod(id_col: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(by)


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
