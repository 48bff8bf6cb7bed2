"""Helpers shared by the vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """True if a vector is there, not empty, and has only finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def common_size(vectors: DataFrame, column: str) -> int:
    """The most frequent vector length; 0 without vectors."""
    row = vectors.groupBy(F.size(column).alias("s")).count().orderBy(F.desc("count"), "s").first()
    return row["s"] if row else 0


def unpacked(column: pa.Array, dtype: str) -> np.ndarray:
    """Matrix of packed vectors of one length."""
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), dtype=dtype).reshape(len(data), -1)
