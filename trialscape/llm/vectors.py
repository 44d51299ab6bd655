"""Vectors in list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components there and finite, not all zero."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows in double precision."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the greatest component first, so that nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of row and row: the sum of products over the root of both sums of squares, each added up
    from the first component to the last, so that a pair has one value wherever it stands."""
    tops = np.abs(a).max(axis=1, initial=1), np.abs(b).max(axis=1, initial=1)
    if max(tops[0].max(initial=0), tops[1].max(initial=0)) > 1e70:
        a, b = a / tops[0][:, None], b / tops[1][:, None]
    product, left, right = np.zeros((3, len(a)))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        product += x * y
        left += x * x
        right += y * y
    return np.clip(product / np.sqrt(left * right), -1, 1)
