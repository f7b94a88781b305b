"""Running an Arrow kernel on small slices of its batch."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa

# bytes of the columns that one call of a kernel gets; its arrays are many times that
SLICE_BYTES = 1 << 20


def slices(columns: tuple[pa.Array, ...], most: int = SLICE_BYTES):
    """The columns in stretches of rows, halved until each holds at most ``most`` bytes or is one row."""
    n = len(columns[0])
    if n <= 1 or sum(c.nbytes for c in columns) <= most:
        yield columns
        return
    yield from slices(tuple(c.slice(0, n // 2) for c in columns), most)
    yield from slices(tuple(c.slice(n // 2) for c in columns), most)


def give_back() -> None:
    """Freed memory goes back to the system. Python workers of a plan's other steps wait meanwhile, and live on after their
    task: what their pools keep adds up over all workers of an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def in_slices(kernel):
    """A kernel whose rows don't meet (a result per row), run slice by slice: its temporary arrays stay small
    however many and long the rows of an Arrow batch are."""
    @wraps(kernel)
    def run(*columns: pa.Array) -> pa.Array:
        parts = [kernel(*some) for some in slices(columns)]
        if len(parts) == 1:
            return parts[0]
        whole = pa.concat_arrays(parts)
        del parts
        give_back()
        return whole
    return run
