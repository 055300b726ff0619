"""Arrow batches as numpy matrices, for operators whose kernel is linear algebra inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column of doubles."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width or 1, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(rows, np.float64).reshape(-1)))


def squared_distances(x: np.ndarray, y: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """All squared distances of two sets of rows, from differences, so that far-off sets lose no digits."""
    out = np.empty((len(x), len(y)))
    step = max(1, cells // max(1, y.size))
    for low in range(0, len(x), step):
        out[low : low + step] = ((x[low : low + step, None] - y[None]) ** 2).sum(2)
    return out
