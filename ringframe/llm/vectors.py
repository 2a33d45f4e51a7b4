"""Rows with usable vectors, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(`key`, `vector` as doubles) of the rows whose vector has no null, NaN or infinite entry, and the vectors' length.

    Of vectors of different lengths those of the most common length stay, of the longest one among equally common ones.
    """
    entries = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col(f"`{key}`").alias("key"), entries.alias("vector")).where(F.col("vector").isNotNull() & sound)
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    width = common.n if common else 0
    return rows.where(F.size("vector") == width), width


def steps(column: pa.Array, width: int, most: int) -> np.ndarray:
    """floor(64 c) of all entries as integers, a row for each vector; what lies beyond +-`most` counts as that."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat), -most, most).astype(np.int64).reshape(len(column), width)
