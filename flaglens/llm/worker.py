"""What a Python worker keeps between tasks: the cache of one operator at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def hold(name: str, forget: Callable[[], None]) -> None:
    """Keep this operator's cache on the worker and forget other operators' ones, as workers outlive stages."""
    others = [k for k in _held if k != name]
    for other in others:
        _held.pop(other)()
    if others:
        trim()
    _held[name] = forget


def trim() -> None:
    """Give memory that isn't used back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(name: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run() of a task without other operators' caches, and without what it leaves unused."""

    def task(batches: Iterator) -> Iterator:
        hold(name, _held.get(name, lambda: None))
        yield from run(batches)
        trim()

    return task
