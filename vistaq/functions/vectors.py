"""Vector arithmetic: exact double folds as Columns, and NumPy kernels for Arrow batches.

The Column forms add in index order in double precision, so that another engine
gives the same bits; they are interpreted per element and fit the few rows that
survive a top-k.  Whole tables go through the kernels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return dot(a, b) / (norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """The vector at length 1, in doubles."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)))


def logit(similarity: Column, scale: float, bias: float = 0.0) -> Column:
    return similarity * F.lit(float(scale)) + F.lit(float(bias))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector, their values as float32); null vectors are left out.

    A width that differs, within the column or from ``width``, is an error.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    held = column.drop_null()
    if not len(held):
        return rows, np.zeros((0, width or 0), np.float32)
    lengths = np.diff(held.offsets.to_numpy())
    width = width or int(lengths[0])
    if (lengths != width).any():
        raise ValueError(f"vectors of width {sorted(set(lengths.tolist()))}, expected {width}")
    return rows, held.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products added in index order in doubles, as the Column form does; ``b`` is as many rows, or one."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i].astype(np.float64) * np.asarray(b[..., i], np.float64)
    return out


def unit_rows(values: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), floor)
