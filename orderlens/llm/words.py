"""Words of Arrow text columns as numpy arrays: boundaries, 64-bit names, names of word windows.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return. Texts are handled in chunks of half a megabyte, a longer text alone, so memory follows the
longest text and never the batch. A word's name is the sum, over its bytes, of a random number of the
byte times one of its place in the word, mixed. It is no polynomial in the place, under which long
words of two letters could be made to share a name whatever the base; two different words share one
with a chance of about 2**-58 a pair. Windows of words are named from their words' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled together.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Places whose numbers are kept; those of longer words are made anew each time.
_PLACES = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit names over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _numbers(first: int, n: int) -> np.ndarray:
    """Random odd numbers by position in a fixed sequence."""
    return mix(np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) | np.uint64(1)


_OF_BYTE = _numbers(1 << 40, 256)
_OF_PLACE = _numbers(0, _PLACES)


@dataclass
class Chunk:
    """Some texts of a batch, their bytes one after another."""

    first: int  #: row of the batch
    rows: int
    data: np.ndarray  #: uint8
    offsets: np.ndarray  #: rows + 1 positions in data


@dataclass
class Words:
    """The words of a chunk, in order."""

    start: np.ndarray  #: byte positions in the chunk
    stop: np.ndarray  #: exclusive
    name: np.ndarray  #: uint64
    row: np.ndarray  #: row in the chunk
    bounds: np.ndarray  #: rows + 1 word positions: the words of row r are bounds[r]:bounds[r + 1]


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column; null becomes the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    return column


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, for work that copies texts."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts in order, several to a chunk of about ``size`` bytes."""
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, last - first, content[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words_of(chunk: Chunk) -> Words:
    """Boundaries and names of the words of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), none, np.zeros(chunk.rows + 1, dtype=np.int64))
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    length = stop - start
    longest = int(length.max(initial=0))
    of_place = _OF_PLACE if longest <= _PLACES else _numbers(0, longest)
    # The bytes of words alone, one word after another.
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length)
    sums = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[data[inside]] * of_place[place], out=sums[1:])
    name = mix(sums[ends] - sums[ends - length] + length.astype(np.uint64))
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    return Words(start, stop, name, row, bounds)


def window_names(name: np.ndarray, size: int) -> np.ndarray:
    """Name of ``name[i : i + size]`` for each i; the caller leaves out windows over a boundary."""
    n = len(name) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = name[:n].copy()
    for k in range(1, size):
        out *= _WINDOW_BASE
        out += name[k : k + n]
    return mix(out)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of ``size`` words of one row begins."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(bounds[:-1] - (ends - counts), counts)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ... `` for ``length[i]`` numbers each, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


def covered(size: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in the union of the ranges."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, stop, -1)
    return np.cumsum(steps[:-1]) > 0
