"""Wrappers for functions that run in Python workers, which live on between tasks and share an executor's memory."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Gives freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def streaming(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For mapInArrow: releases memory when a partition is done."""

    def run(stream: Iterator) -> Iterator:
        try:
            yield from work(stream)
        finally:
            release()

    return run


def grouped(work: Callable) -> Callable:
    """For applyInArrow, of one to three arguments: releases memory when a group is done."""

    def one(table):
        out = work(table)
        release()
        return out

    def two(key, table):
        out = work(key, table)
        release()
        return out

    def three(key, left, right):
        out = work(key, left, right)
        release()
        return out

    return (one, two, three)[len(inspect.signature(work).parameters) - 1]
