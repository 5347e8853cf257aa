"""Integer vectors of embedding tables, and their rows as numpy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True where the vector is there and none of its entries is null, NaN or infinite."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), ok), F.lit(False))


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """``floor(scale * entry)`` of every entry as long."""
    return F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))).cast("long"))


def same_length(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Vectors padded with zeros to the length of the longest, or to one entry if all are empty, and that length."""
    least, most = df.agg(F.coalesce(F.min(F.size(vector)), F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    most = max(1, most)
    if least < most:
        df = df.withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size(vector))))
    return df, most


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list<long> column whose lists all have ``dim`` entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)
