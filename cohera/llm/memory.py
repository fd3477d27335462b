"""A bounded memory of worked-out values, for use within a worker, and memory given back at a task's end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: glibc alone has it; elsewhere freed memory is left to the allocator.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps workers for later tasks, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function from batches to batches, followed by give_back()."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class Memory(dict):
    """Remembers make(key) for short keys in two generations: what is asked for again outlives a change."""

    def __init__(self, make, most: int, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made

    def forget(self) -> None:
        self.clear()
        self.old = {}
