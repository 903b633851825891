"""Vectors on an integer grid, as columns and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid components stay below this size, so that products and squares summed over 2,048 components fit a long.
LIMIT = 2**26


def grid_vectors(df: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """Rows (vec_id, vector array<int>) with each component x as floor(scale * x), x as double.

    Vectors that are null, hold null or non-finite components or, if `dims` is given, have another length, are left out.
    Null ids and repeated rows stay. A grid component of LIMIT or more raises an error. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_x"))
    usable = F.col("_x").isNotNull() & F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if dims is not None:
        usable &= F.size("_x") == dims
    cell = lambda x: F.when(F.abs(x * scale) < LIMIT - 1, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("vector component out of range")).cast("int"))
    # the condition is part of the expression, since filters may be evaluated in any order
    return rows.select("vec_id", F.when(usable, F.transform("_x", cell)).alias("vector")).where("vector is not null")


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a float matrix; absent components are 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims).astype(float)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
