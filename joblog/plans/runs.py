"""Runs of equal keys in sorted Arrow batches, for folds inside ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def _codes(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and column.null_count == 0:
        return column.to_numpy()
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def key_runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """Yield (key, start, stop) for each stretch of rows with equal keys."""
    if batch.num_rows == 0:
        return
    columns = [batch.column(k) for k in keys]
    change = np.zeros(batch.num_rows, dtype=bool)
    for column in columns:
        codes = _codes(column)
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.concatenate(([0], np.flatnonzero(change)))
    stops = np.append(starts[1:], batch.num_rows)
    for start, stop in zip(starts.tolist(), stops.tolist()):
        yield tuple(c[start].as_py() for c in columns), start, stop
