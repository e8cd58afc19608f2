"""Vectors in Arrow batches as dense matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dense(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a (rows, dim) double matrix; raises on uneven lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    if dim is None:
        dim = int(lengths[0]) if len(lengths) else 0
    if column.null_count or (lengths != dim).any():
        raise ValueError(f"expected vectors of length {dim}, found {sorted(set(lengths.tolist()))}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.float64)


def list_column(matrix: np.ndarray, value_type: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(0, rows * dim + 1, dim, dtype=np.int32)) if dim else None
    if offsets is None:
        return pa.array([[]] * rows, pa.list_(value_type))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), value_type))
