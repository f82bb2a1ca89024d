"""What the vector operators share: which vectors count, classes of equal ones, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zeros."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(sound, F.lit(False))


def rows_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vector, one, two, sound)``; ``one`` and ``two`` are hashes that name the class of
    equal vectors. -0.0 and 0.0 are equal."""
    kind = vectors.schema[vector].dataType.elementType
    plain = F.transform(F.col(vector), lambda x: (x + F.lit(0.0)).cast(kind))
    rows = vectors.select(F.col(key).cast("long").alias("id"), plain.alias("vector"))
    return rows.select(
        "id",
        "vector",
        F.xxhash64("vector", F.lit(1)).alias("one"),
        F.xxhash64(F.lit(2), "vector", F.size("vector")).alias("two"),
        (usable("vector") & F.col("id").isNotNull()).alias("sound"),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares of large numbers stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
