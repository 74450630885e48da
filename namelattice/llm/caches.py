"""What Python workers keep between tasks, an operator at a time.

Workers outlive stages; without this, each operator's store would stay beside
the next one's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_EMPTY: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def register(name: str, empty: Callable[[], None]) -> None:
    _EMPTY[name] = empty


def keep_only(name: str) -> None:
    """Empty the stores of all operators but this one in this worker, and give their memory back."""
    if _OWNER == [name]:
        return
    for other, empty in _EMPTY.items():
        if other != name:
            empty()
    if _OWNER:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps what it holds
            pass
    _OWNER[:] = [name]
