"""Workers that give memory back: Spark keeps Python workers for the next task, with all that their allocators still hold."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library; it has its own ways
        pass


def frugal(run: Callable[[Batches], Batches], every: int = 8) -> Callable[[Batches], Batches]:
    """The Arrow function, with free memory handed to the system after every few batches and at the end."""

    def saving(parts: Batches) -> Batches:
        try:
            for i, b in enumerate(run(parts)):
                yield b
                del b
                if i % every == every - 1:
                    give_back()
        finally:
            give_back()

    return saving
