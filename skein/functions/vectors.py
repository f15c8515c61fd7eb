"""Vectors in array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: Column | str, dim: int) -> Column:
    """Whether a vector has dim finite elements that aren't all zero; built-in functions without lambdas."""
    c = F.col(col) if isinstance(col, str) else col
    inf = float("inf")
    size = F.size(F.array_compact(c))
    # array_max puts NaN above all numbers, so the comparison with infinity rejects it
    return F.coalesce((F.size(c) == dim) & (size == dim) & (F.array_max(c) < inf) & (F.array_min(c) > -inf) & ((F.array_max(c) != 0) | (F.array_min(c) != 0)), F.lit(False))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision; null where a vector is null or lengths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) doubles of a list column without nulls and with rows of dim elements."""
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def pairwise_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b (small blocks), exact to rounding, never negative."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0.0)
