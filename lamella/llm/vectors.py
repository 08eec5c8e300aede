"""Vectors of integers inside Arrow batches, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vec: str) -> Column:
    """Whether the vector is there and none of its components is null, NaN or infinite."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(ok, F.lit(False))


def scaled(vec: str, scale: float, most: int) -> Column:
    """floor(scale * x) of each component as int, x as double; beyond -most and most it stays there."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * F.lit(scale)))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all of ``width`` values, as one array."""
    return np.asarray(column.flatten()).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of an array as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel(), kind))
