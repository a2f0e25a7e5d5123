"""Groups of rows handled in one pass over sorted partitions, many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of rows compared at once.
_PAIRS = 1 << 19


def over_groups(
    frame: DataFrame,
    groups: list[str],
    use: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None],
    kinds: str,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """``use(rows, starts)`` over whole groups: ``starts`` is where each begins in ``rows``, with the end at last.

    Rows of a group lie together in a sorted partition, by ``order``. A task holds one batch and the
    group it ends in, so groups must be bounded (see ``in_blocks``). Group columns hold no nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            new = np.zeros(table.num_rows - 1, dtype=bool)
            for name in groups:
                values = table.column(name).to_numpy()
                new |= values[1:] != values[:-1]
            starts = np.r_[0, np.flatnonzero(new) + 1]
            held = table.slice(int(starts[-1]))
            if len(starts) > 1 and (made := use(table.slice(0, int(starts[-1])), starts)) is not None:
                yield made
        if held is not None and (made := use(held, np.array([0, held.num_rows]))) is not None:
            yield made

    return frame.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(run, kinds)


def in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of groups of ``n``, copied so that any two of a group meet in one pair of blocks ``x <= y``.

    Groups up to ``block`` stay whole. A group of many blocks goes to as many tasks as it has pairs of
    them, each of at most two blocks; ``own`` is the row's block, by its ``key``.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), blocks).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")


def pairs(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of rows of one group that its pair of blocks is for, some at a time."""
    own, x, y = (rows.column(c).to_numpy() for c in ("own", "x", "y"))
    n = rows.num_rows
    partners = np.repeat(starts[1:], np.diff(starts)) - np.arange(n) - 1
    total = np.r_[0, np.cumsum(partners)]
    first = 0
    while first < n:
        last = max(int(np.searchsorted(total, total[first] + _PAIRS, side="right")) - 1, first + 1)
        count = partners[first:last]
        left = np.repeat(np.arange(first, last), count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        due = (x[left] == y[left]) | (own[left] != own[right])
        yield left[due], right[due]
        first = last


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new
