"""Whitening of embedding vectors on their leading principal components.

Entries are turned into whole numbers first, so counts and sums are exact. One pass finds the sums,
one the covariance, centred by the whole number next to each mean (what is left of the mean, less
than a half, is corrected exactly); the eigenpairs come from spectrum slicing of the covariance, and
a third pass projects. Each pass sends one small table per task. What reaches the driver are sums and
the covariance, whose size follows from the number of dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import stored
from .spectrum import Eigenpair, leading_eigenpairs

#: Steps of an entry of one, and the number added so that usual entries are positive.
STEPS, LIFT = 1024, 100_000
#: Entries handled together.
_AT_ONCE = 1 << 21
_LARGEST = float(1 << 62)


@dataclass
class Whitening:
    """What a fit found; ``sums`` are exact, components are rows."""

    n: int
    sums: list[int]
    pairs: list[Eigenpair]
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centres(self) -> tuple[np.ndarray, list[int]]:
        """The whole number next to each mean, and what the sums are beyond ``n`` times it."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, dtype=np.int64), [s - self.n * m for s, m in zip(self.sums, near, strict=True)]


def _vectors(frame: DataFrame, columns: list[str], vector: str) -> DataFrame:
    """The columns under position names, then the vector as ``vector``; nothing else, so no name can clash."""
    kind = frame.select(F.col(f"`{vector}`")).schema[0].dataType
    column = F.col(f"`{vector}`")
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        column = column.cast("array<double>")
    return frame.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], column.alias("vector"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches in parts of bounded size: the rows, their entries, where each begins, and the length (-1 if it goes)."""
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            column = batch.column(batch.num_columns - 1).slice(first)
            ends = column.offsets.to_numpy()
            size = max(int(np.searchsorted(ends, ends[0] + _AT_ONCE, side="right")) - 1, 1)
            part = batch.slice(first, size)
            column = part.column(part.num_columns - 1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
            start = offsets - offsets[0]
            with np.errstate(invalid="ignore", over="ignore"):
                bad = ~(np.abs(entries * STEPS) < _LARGEST)
            before = np.r_[0, np.cumsum(bad)]
            usable = (before[start[1:]] == before[start[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
            yield part, entries, start[:-1], np.where(usable, np.diff(start), -1)
            first += size


def _whole(entries: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The whole numbers of some vectors of one width, a row each."""
    return np.floor(entries[start[:, None] + np.arange(width)] * STEPS).astype(np.int64) + LIFT


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums, also beyond 64 bits."""
    if x.size and int(np.abs(x).max()) > (1 << 62) // len(x):
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def _sums(rows: DataFrame) -> DataFrame:
    """``width, n, sums`` of the usable vectors, one row per task and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}

        def made() -> pa.RecordBatch:
            sums = [[Decimal(s) for s in sums] for _, sums in found.values()]
            columns = [
                pa.array(list(found), pa.int32()),
                pa.array([n for n, _ in found.values()], pa.int64()),
                pa.array(sums, pa.list_(pa.decimal128(38, 0))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["width", "n", "sums"])

        for _, entries, start, width in _parts(batches):
            for w in np.unique(width[width > 0]).tolist():
                x = _whole(entries, start[width == w], w)
                n, sums = found.get(w, (0, [0] * w))
                found[w] = (n + len(x), [a + b for a, b in zip(sums, _exact_sums(x), strict=True)])
            if len(found) > 16:
                yield made()
                found.clear()
        yield made()

    return rows.mapInArrow(run, "width int, n long, sums array<decimal(38,0)>")


def _products(rows: DataFrame, fit: Whitening) -> np.ndarray:
    """Sums of products of the entries less their centres, exact while they stay below 2**53."""
    width, centre = fit.width, fit.centres()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, entries, start, lengths in _parts(batches):
            x = (_whole(entries, start[lengths == width], width) - centre).astype(np.float64)
            total += x.T @ x
        yield from lines(dict(enumerate(total)))

    def lines(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            columns = [pa.array(list(found), pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "products"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
            for line, part in zip(batch.column(0).to_pylist(), values, strict=True):
                found[line] = found[line] + part if line in found else part.copy()
        yield from lines(found)

    kinds = "line int, products array<double>"
    total = np.zeros((width, width))
    # One row of the matrix per dimension, whatever the number of vectors.
    for line, products in rows.mapInArrow(run, kinds).repartition("line").mapInArrow(add, kinds).collect():
        total[line] = products
    return total


def fit_whitening(frame: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """Means and leading principal components of all usable vectors; None where there is no vector.

    A vector is left out if it is null or holds a null, an infinity, a NaN or an entry too large for
    a whole number of 64 bits. Where widths differ, the most frequent width counts (of equal ones
    the largest) and the other rows are left out; empty vectors never count. Repeated rows count
    each. Components whose variance rounding cannot tell from zero are not made, so constant vectors
    have none; of equal variances any orthogonal choice is right, and it is made once for all rows.
    """
    rows = _vectors(frame, [], vector)
    sums = stored(_sums(rows), "whitening-sums")
    widths = sums.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return None
    placed = sums.filter(F.col("width") == widths["width"]).select(F.posexplode("sums"))
    totals = placed.groupBy("pos").agg(F.sum("col").alias("total")).collect()
    fit = Whitening(widths["n"], [0] * widths["width"], [], 0.0)
    for pos, total in totals:
        fit.sums[pos] = int(total)
    rest = np.array([float(r) for r in fit.centres()[1]])
    covariance = (_products(rows, fit) - np.outer(rest, rest) / fit.n) / fit.n
    fit.trace = float(np.trace(covariance))
    fit.pairs = leading_eigenpairs(covariance, components)
    return fit


def whiten(frame: DataFrame, fit: Whitening, columns: list[str], vector: str = "embedding") -> DataFrame:
    """``columns``, ``deviation`` and ``whitened`` (an array, one entry per component) of each usable vector.

    ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``, exact, null where it exceeds a
    64-bit number. Rows that the fit leaves out are left out; the columns may hold anything.
    """
    rows = _vectors(frame, columns, vector)
    width, (centre, rest) = fit.width, fit.centres()
    axes = np.array([p.vector / np.sqrt(p.value) for p in fit.pairs]).reshape(len(fit.pairs), width)
    n, left = fit.n, np.array([r / fit.n for r in rest])
    kept = [pa.field(f"c{i}", pa.null()) for i in range(len(columns))]

    def deviations(x: np.ndarray) -> pa.Array:
        reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, rest), default=0)
        if reach * reach * width < 1 << 63:
            y = n * x - np.array(rest, dtype=np.int64)
            return pa.array(np.einsum("ij,ij->i", y, y))
        exact = ((n * x.astype(object) - np.array(rest, dtype=object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, entries, start, lengths in _parts(batches):
            mine = np.flatnonzero(lengths == width)
            x = _whole(entries, start[mine], width) - centre
            whitened = (x - left) @ axes.T
            offsets = pa.array(np.arange(len(mine) + 1) * len(axes), pa.int32())
            taken = pa.array(mine)
            arrays = [part.column(i).take(taken) for i in range(len(kept))]
            lists = pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel()))
            names = [f.name for f in kept] + ["deviation", "whitened"]
            yield pa.RecordBatch.from_arrays([*arrays, deviations(x), lists], names=names)

    schema = T.StructType([*rows.drop("vector").schema, T.StructField("deviation", T.LongType())])
    found = rows.mapInArrow(run, schema.add("whitened", T.ArrayType(T.DoubleType())))
    return found.toDF(*columns, "deviation", "whitened")


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` less the identity; null without components."""
    if not components:
        return None
    entry = [F.element_at("whitened", i + 1) for i in range(components)]
    means = [F.avg(e) for e in entry]
    errors = [
        F.abs(F.avg(entry[i] * entry[j]) - means[i] * means[j] - (1.0 if i == j else 0.0))
        for i in range(components)
        for j in range(i + 1)
    ]
    return whitened.agg(F.array_max(F.array(*errors))).first()[0]


def op11_whitening(spark: SparkSession, sf_dir: str, components: int = 8) -> DataFrame:
    """Each usable embedding on up to eight whitened components, a row each."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitened_rows(vectors, components)


def whitened_rows(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``; no rows without components."""
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(vectors, components=components)
    if fit is None or not fit.pairs:
        return vectors.sparkSession.createDataFrame([], kinds)
    found = whiten(vectors, fit, ["vec_id"])
    error = identity_error(found, len(fit.pairs))
    shares = F.array(*[F.lit(p.value / fit.trace) for p in fit.pairs])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        F.col("vec_id").cast("long"),
        (F.col("place") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
