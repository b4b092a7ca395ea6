"""Arrow batches in small slices, so that a worker holds the Python strings of few rows at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows; what the worker no longer needs goes back to the system at the end."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def release() -> None:
    """Workers are used again and keep freed memory; other processes on the machine need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def forget_tokenizers() -> None:
    """Drops the tokenizers that an earlier task left in this worker."""
    module = sys.modules.get(f"{__package__}.token_ids")
    if module is not None:
        module._OPEN.clear()
