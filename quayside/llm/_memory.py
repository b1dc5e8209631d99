"""Memory of Python workers, which stay between tasks and stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")


def give_back() -> None:
    """Return what this worker has freed to the machine.

    Allocators keep freed memory for later, and a worker that waits would hold it beside the memory that
    Spark's own stages take next. Does nothing where the C library has no `malloc_trim`.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[..., T], *args: object) -> T:
    """`run(*args)`; what it has freed when it returns is given back."""
    out = run(*args)
    give_back()
    return out


def tidied_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, a function for `mapInArrow`; what it has freed at its end is given back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidy
