"""Vectors of a column, checked, as numpy rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix as double) of the vectors without null or non-finite components, those of one
    length together. Null vectors and vectors without components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets)
    values = column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(flat)
    if values.null_count:
        bad |= ~np.asarray(values.is_valid())
    before = np.concatenate([[0], np.cumsum(bad)])
    sizes = np.diff(ends)
    good = np.asarray(column.is_valid()) & (before[ends[1:]] == before[ends[:-1]]) & (sizes > 0)
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        yield rows, flat[ends[rows][:, None] + np.arange(size)]
