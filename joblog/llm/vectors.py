"""Vector columns in Arrow batches, for operators over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vector_lengths(column: pa.Array) -> np.ndarray:
    """The number of entries of each vector; -1 for null."""
    if pa.types.is_null(column.type):
        return np.full(len(column), -1, np.int64)
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return lengths


def finite_vectors(column: pa.Array, dims: int, below: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors with exactly ``dims`` entries, none null, not finite or of magnitude ``below`` or more."""
    rows = np.flatnonzero(vector_lengths(column) == dims) if dims else np.empty(0, np.int64)
    if not len(rows):
        return rows, np.empty((0, dims))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    found = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(dims)]
    sound = (np.abs(found) < below).all(axis=1)  # False for NaN
    return rows[sound], found[sound]
