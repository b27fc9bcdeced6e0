"""Memory of Python workers, which outlive tasks and serve one operator after another."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_KEPT: dict[tuple, object] = {}


def kept(key: tuple, build: Callable[[], object]) -> object:
    """What build() makes, kept from task to task until another key is asked for: a worker holds one operator's tables."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def drop_kept() -> None:
    _KEPT.clear()


def hand_back() -> None:
    """Give freed memory back to the machine, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable:
    """run, a function of record batches, that hands back at its end what it freed; unless it keeps tables, others' go first."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        yield from run(batches)
        hand_back()

    return tidied
