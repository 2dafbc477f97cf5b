"""Arrow batches in portions, so that what Python makes of them doesn't grow with the rows of a batch."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a row of more is a portion of its own.
BYTES = 1 << 19


def _bytes(c):
    """Bytes of text in each row of a column of strings, of structs or of arrays of them, and one more for the row."""
    if pa.types.is_list(c.type):
        upto = np.append(0, np.cumsum(_bytes(c.flatten())))
        return np.diff(upto[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)))]) + 1
    if pa.types.is_struct(c.type):
        return sum((_bytes(x) for x in c.flatten()), np.ones(len(c), np.int64))
    if not pa.types.is_string(c.type):
        return np.ones(len(c), np.int64)
    return pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def portions(columns, most: int | None = None):
    """(from, to) of runs of a batch's rows, in order, each of so many bytes of text or of one row. What is made of one can be given up before the next."""
    most = BYTES if most is None else most
    upto = np.append(0, np.cumsum(sum(_bytes(c) for c in columns)))
    a = 0
    while a < len(upto) - 1:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, side="right")) - 1)
        yield a, b
        a = b


def hand_back():
    """Gives memory that a task no longer needs back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc
