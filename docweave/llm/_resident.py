"""What operators leave in a Python worker between tasks, and letting go of it.

A worker is forked once and serves the tasks of all stages. A tokenizer with its
caches or an automaton that one operator keeps in it counts in the executor's
memory while other stages run. A stage that keeps nothing itself lets go of what
others left; these make it again when a task of theirs comes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_tables: list[dict] = []


def resident() -> dict:
    """A module's table of what a worker keeps from task to task."""
    _tables.append({})
    return _tables[-1]


def give_back() -> None:
    """Hand freed memory back to the system: Arrow's pool and C's heap keep what
    a batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Empty the tables of all operators."""
    if any(_tables):
        for table in _tables:
            table.clear()
        gc.collect()
    give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, alone: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker's tasks, with the memory of its batches given back at
    the end; ``alone``: without what other operators left in the worker."""

    def tidied(batches):
        if alone:
            let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
