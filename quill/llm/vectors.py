"""Vectors of a column as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled entries are kept inside this range, so that sums of two stay in a long.
MOST = 2**62


def is_whole(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite entries."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def by_length(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of doubles) for each length of the vectors of a column without nulls."""
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    values = column.values.to_numpy(zero_copy_only=False)
    found = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        found.append((rows, values[ends[:-1][rows][:, None] + np.arange(size)]))
    return found


def scaled(matrix: np.ndarray, scale: float, offset: int = 0) -> np.ndarray:
    """floor(scale * entry) + offset as whole numbers; beyond 2^62 they stay at that bound."""
    return np.clip(np.floor(matrix * scale), -MOST, MOST).astype(np.int64) + offset
