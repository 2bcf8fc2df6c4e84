"""Vectors of a table as packed little-endian doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vec_col: str) -> Column:
    """True for a vector that is there, not empty, and holds finite numbers only."""
    bad = F.exists(F.col(vec_col).cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad, F.lit(False))


def double_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of packed vectors of ``dim`` doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)


def list_matrix(column: pa.Array, dim: int, kind: str = "f8") -> np.ndarray:
    """A list column whose rows all hold ``dim`` numbers as a matrix."""
    return np.asarray(column.flatten(), kind).reshape(len(column), dim)
