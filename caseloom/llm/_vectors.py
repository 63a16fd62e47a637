"""Vectors as integers, and blocks of them as bytes: what the two vector operators share.

An entry c becomes floor(256 * c). A vector is *usable* if it is not null and every entry is finite and becomes an integer that fits a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries are multiplied by this before they are rounded down.
SCALE = 256.0
#: Doubles from here on don't fit a long.
LONG_LIMIT = 2.0**63


def usable(vector: Column) -> Column:
    """Whether a vector is usable; never null. A vector without entries isn't."""
    fits = F.forall(vector, lambda c: F.coalesce((F.abs(c.cast("double") * SCALE) < LONG_LIMIT) & ~F.isnan(c), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * c) of every entry as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of ``dims`` integers each as an int64 matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), dims)


def to_bytes(values: np.ndarray) -> tuple[bytes, int]:
    """Integers in as few bytes each as hold them all, and that number of bytes."""
    most = max(-int(values.min()) - 1, int(values.max())) if values.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return values.astype(f"<i{width}").tobytes(), width


def from_bytes(data: bytes, width: int, dims: int) -> np.ndarray:
    """The int64 matrix of ``to_bytes``."""
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dims)
