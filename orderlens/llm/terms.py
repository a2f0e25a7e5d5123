"""Terms of Arrow text columns: maximal runs of digits, ASCII letters and characters beyond ASCII.

Only A-Z are lower-cased. All bytes of a character beyond ASCII belong to terms, so runs of bytes
are runs of characters. Terms are kept as their bytes and compared as such, never by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import Chunk

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


@dataclass
class Terms:
    """The terms of a chunk, in order."""

    names: pa.LargeBinaryArray
    bounds: np.ndarray  #: rows + 1 positions: the terms of row r are bounds[r]:bounds[r + 1]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings ``data[offsets[i]:offsets[i + 1]]``."""
    where = pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64))
    content = pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, where, content])


def terms_of(chunk: Chunk) -> Terms:
    """The lower-cased terms of each text of a chunk."""
    if not len(chunk.data):
        return Terms(binaries(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(chunk.rows + 1, dtype=np.int64))
    data = _LOWER[chunk.data]
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # A text that begins right after the last term of the one before begins a term of its own.
    cuts = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - start, out=offsets[1:])
    return Terms(binaries(data[inside], offsets), np.searchsorted(start, chunk.offsets))
