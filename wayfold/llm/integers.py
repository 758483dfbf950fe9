"""Whole-number vectors: what the operators on exact integer arithmetic share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
#: Whole components are held within this bound, so that inner products and squared distances fit 64 bits.
LIMIT = 1 << 20


def finite(vector: Column) -> Column:
    """A vector that is there, without null or non-finite components."""
    v = vector.cast("array<double>")
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floored(vector: Column, scale: int = SCALE, limit: int = LIMIT) -> Column:
    """floor(scale * x) of each component, held within ``limit``."""
    bounded = lambda x: F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), F.floor(x * F.lit(float(scale))).cast("double")))
    whole = lambda x: F.when(F.abs(x) * scale < float(limit), bounded(x)).otherwise(F.signum(x) * float(limit)).cast("int")
    return F.transform(vector.cast("array<double>"), whole)


def padded(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) integers; shorter vectors end in zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends - size, size)] = flat
    return out
