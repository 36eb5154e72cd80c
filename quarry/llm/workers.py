"""Giving memory back between the tasks that a Python worker runs one after the other."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Return freed blocks to the system: numpy's and Arrow's allocators keep them otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that releases what it has freed after each output and at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        try:
            for out in run(batches):
                yield out
                sent += out.nbytes
                if sent > 32 << 20:
                    del out
                    release()
                    sent = 0
        finally:
            release()

    return wrapped
