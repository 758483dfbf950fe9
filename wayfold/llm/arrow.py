"""Helpers for functions that Spark runs over Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose strings in ``name`` hold about ``limit`` bytes; one longer string is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def strings(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    for a in range(0, len(column), step):
        yield from column.slice(a, step).to_pylist()


def freed(fn):
    """For functions over batches: give memory back to the system at the end of a task, as workers live on."""
    @functools.wraps(fn)
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return run
