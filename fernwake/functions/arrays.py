"""Arrow list columns as NumPy matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def to_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``column`` with exactly ``dim`` entries as a float matrix, and which rows those are.

    Null entries become NaN; null lists and lists of another length are not taken.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    taken = np.asarray(fits)
    flat = (column if taken.all() else column.filter(fits)).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim), taken


def from_matrix(m: np.ndarray, kind: pa.DataType = pa.float32()) -> pa.Array:
    n, dim = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(m).ravel(), kind))
