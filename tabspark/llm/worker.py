"""Memory of Python workers.  A worker serves many tasks, and those of other operators after them, so what one task leaves there
counts in all that follow, beside the executor's own heap."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa

_kept: dict[tuple[str, Hashable], Any] = {}


def keep(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once a worker, until a task of another kind runs there (see ``lean``)."""
    if (kind, key) not in _kept:
        _kept[kind, key] = make()
    return _kept[kind, key]


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not the GNU C library
        return None


def give_back() -> None:
    """Hand what freed arrays, strings and Arrow buffers still occupy back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def make_room(keeps: str) -> None:
    """Drop what tasks of another kind have kept in this worker."""
    others = [k for k in _kept if k[0] != keeps]
    for k in others:
        del _kept[k]
    if others:
        give_back()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for ``mapInArrow``: before it, what tasks of another kind than ``keeps`` have kept in its worker goes; after it, its free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(keeps)  # a function of the module: ``run`` travels by value and would bring a table of its own
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
