"""What a Python worker keeps between batches and tasks: one thing at a time.

Workers are reused by whatever runs next, so caches that each operator kept for
itself would add up.  Here an operator's state (an encoder with its caches, an
index) takes the one place there is; when another operator starts, the earlier
state is let go and its memory is given back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: dict[Hashable, Any] = {}


def give_back() -> None:
    """Return freed memory to the system, as far as allocators let go of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to trim
        pass


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's state of this key, made if it isn't the one at hand; the state of any other key is dropped first."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]
