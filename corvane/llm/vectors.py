"""What the vector operators share: valid vectors as bytes, bounded samples, matrices from batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(vector: str = "embedding") -> Column:
    """Neither null, nor empty, nor zero, nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_double(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vector column as an array of doubles; float components convert exactly."""
    return df.withColumn(vector, F.col(vector).cast(T.ArrayType(T.DoubleType())))


def matrix(column) -> np.ndarray:
    """Rows of a pandas or Arrow column of equally long lists as a matrix."""
    values = column.to_numpy(zero_copy_only=False) if hasattr(column, "to_pylist") else column.to_numpy()
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.empty((0, 0))


def sample_matrix(df: DataFrame, key: str, vector: str, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, chosen by a hash of ``key``; the only vectors that reach the driver."""
    got = df.select(key, vector).orderBy(F.xxhash64(key), key).limit(rows).collect()
    return np.array([r[vector] for r in got], dtype=np.float64) if got else np.empty((0, 0))
