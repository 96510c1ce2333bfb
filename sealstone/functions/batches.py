"""Arrow batches in pieces of bounded bytes: a batch is bounded by rows alone, and rows may be whole texts or files."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a piece, about; a row of more is a piece of its own.
PIECE = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return freed memory to the system, so that a worker holds no more than what it works on."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def bounds(column: pa.Array, most: int = PIECE) -> list[tuple[int, int]]:
    """(first row, rows) of pieces of a text or binary column, in order."""
    if not len(column):
        return []
    _, off, _ = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(off, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out, at = [], 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        out.append((at, upto - at))
        at = upto
    return out


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each; memory is given back behind each batch."""
    for batch in batches:
        for first, rows in bounds(batch.column(column), most):
            yield batch.slice(first, rows)
        del batch
        give_back()
