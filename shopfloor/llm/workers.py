"""Memory of Python workers.

Spark hands a worker on from task to task, also to those of other operators and
of steps without Python. What an operator remembers there stands beside all that
comes later, and so does memory that allocators keep though it is free.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this worker remembers for an operator, until a task of another one has its turn."""
    return _kept.setdefault(owner, {})


def _give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
        if trim:
            trim(0)


def _begin(owner: str) -> None:
    others = [k for k in _kept if k != owner and _kept[k]]
    for k in others:
        _kept[k].clear()
    if others:
        _give_back()


def own_turn(owner: str = "") -> Callable[[Callable], Callable]:
    """Of a task's function, a generator: it begins without what others remember, and ends without free memory."""

    def turn(run: Callable) -> Callable:
        @wraps(run)
        def task(batches: Iterator) -> Iterator:
            _begin(owner)  # by name: a task is pickled together with the variables it names
            try:
                yield from run(batches)
            finally:
                _give_back()

        return task

    return turn
