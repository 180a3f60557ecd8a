"""What the two embedding operators share: vectors out of rows, and rows out of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector_col: str) -> Column:
    """Whether a vector is not null or empty and all its components are finite numbers."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~bad


def matrix(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of numbers, filled with zeros to the longest."""
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out
