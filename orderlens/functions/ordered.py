"""Exact quantiles and running sums over values too many for one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer,
and a window without a partition key sorts everything in one task. Here the work is spread
by a fixed, non-decreasing function that assigns each value to an interval, about 0.008 %
wide relative to the value, whatever its size. The intervals only divide the work and never
change a result.

* ``column_quantiles`` counts rows per interval (a few ten thousand counters, combined on
  the map side), finds the intervals that hold a wanted rank, and reads the input once more
  for the values in just those. The data itself is never shuffled.
* ``running_sums`` and ``quantiles_of_counts`` start from one row per distinct value. A
  value that holds a third of all rows is one such row. Interval totals are added up first,
  then every interval is finished in parallel as a window partition of its own. Running sums
  divide each interval once more, so values crowded within a ten-thousandth still spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Intervals per doubling of the absolute value, and parts of an interval.
RESOLUTION = 8192
PARTS = 1024
# Above the logarithm of the least positive double, so that all places are positive.
_LEAST_POWER = 1075


def interval(value: Column, resolution: int = RESOLUTION) -> Column:
    """Interval number of a value; non-decreasing in the value, 0 for zero alone."""
    value = value.cast("double")
    place = F.floor((F.log2(F.abs(value)) + _LEAST_POWER) * resolution) + 1
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * place).cast("bigint")


def _before(column: str, keys: Sequence[str], order: Column) -> Column:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., value, n)``: rows per distinct non-null value."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def running_sums(
    grouped: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` per ``s`` in ``sums``.

    The first sums over the rows ordered before, the second over all rows of the group.
    ``grouped`` has one row per ``(by..., value)`` and no null values. Ascending means
    over smaller values, descending over greater ones.
    """
    def order(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    placed = grouped.withColumn("_bucket", interval(F.col(value)))
    placed = placed.withColumn("_part", interval(F.col(value), RESOLUTION * PARTS))
    keys = [*by, "_bucket"]
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    totals = parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *keys,
        *[_before(s, by, order("_bucket")).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )
    within = parts.select(*keys, "_part", *[_before(s, keys, order("_part")).alias(f"_in_{s}") for s in sums])
    fine = [*keys, "_part"]
    return placed.join(within.join(offsets, keys), fine).select(
        *grouped.columns,
        *[(F.col(f"_off_{s}") + F.col(f"_in_{s}") + _before(s, fine, order(value))).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def _covers(start: Column, size: Column, rank: Column) -> Column:
    return (start <= rank) & (rank < start + size)


def _positions(probabilities: Sequence[float]) -> list[Column]:
    """Fractional zero-based rank of each probability among ``_rows`` rows."""
    return [(F.col("_rows") - 1) * F.lit(float(p)) for p in probabilities]


def _wanted_intervals(totals: DataFrame, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``(by..., _bucket, _off, _rows)`` of the intervals that hold a wanted rank.

    ``totals`` is ``(by..., _bucket, n)``. At most two intervals per group and probability.
    """
    offsets = totals.select(
        *by,
        "_bucket",
        F.col("n").alias("_size"),
        _before("n", by, F.col("_bucket").asc()).alias("_off"),
        F.sum("n").over(Window.partitionBy(*by)).alias("_rows"),
    )
    hit = F.lit(False)
    for position in _positions(probabilities):
        for rank in (F.floor(position), F.ceil(position)):
            hit = hit | _covers(F.col("_off"), F.col("_size"), rank)
    return offsets.filter(hit).drop("_size")


def _interpolate(
    counted: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Quantiles from ``(by..., _bucket, value, n, _off, _rows)`` rows of the wanted intervals."""
    keys = [*by, "_bucket"]
    ranked = counted.withColumn("_start", F.col("_off") + _before("n", keys, F.col(value).asc()))
    positions, picked = _positions(probabilities), []
    for i, position in enumerate(positions):
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            at_rank = _covers(F.col("_start"), F.col("n"), rank)
            picked.append(F.max(F.when(at_rank, F.col(value).cast("double"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*by).agg(F.max("_rows").alias("_rows"), *picked)
    values = [
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position - F.floor(position))
        for i, position in enumerate(positions)
    ]
    return found.select(*by, F.col("_rows").alias("n"), F.array(*values).alias("quantiles"))


def quantiles_of_counts(
    counted: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles from ``value_counts`` output.

    Returns ``by...``, ``n`` (rows), and ``quantiles`` (array of DOUBLE in the order of
    ``probabilities``).
    """
    placed = counted.withColumn("_bucket", interval(F.col(value)))
    totals = placed.groupBy(*by, "_bucket").agg(F.sum("n").alias("n"))
    hits = _wanted_intervals(totals, probabilities, by)
    return _interpolate(placed.join(hits, [*by, "_bucket"]), value, probabilities, by)


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """``(keep..., column_name, value)``: the non-null values of the columns under one another, as DOUBLE."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    stacked = df.select(*keep, F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, value)"))
    return stacked.filter(F.col("value").isNotNull())


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], times: Column | None = None
) -> DataFrame:
    """Quantiles of several columns together: ``column_name, n, quantiles``.

    A row counts ``times`` times, once if not given. The broadcast side has at most two rows per
    column and probability.
    """
    by = ["column_name"]
    counted_as = [] if times is None else [times.alias("_times")]
    count = (F.count("*") if times is None else F.sum("_times")).alias("n")
    placed = long_values(df, columns, counted_as).withColumn("_bucket", interval(F.col("value")))
    totals = placed.groupBy(*by, "_bucket").agg(count)
    hits = _wanted_intervals(totals, probabilities, by)
    counted = (
        placed.join(F.broadcast(hits), [*by, "_bucket"])
        .groupBy(*by, "_bucket", "value", "_off", "_rows")
        .agg(count)
    )
    return _interpolate(counted, "value", probabilities, by)


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> Column:
    """The quantiles of each column as a scalar struct of arrays, one field per column."""
    found = column_quantiles(df, columns, probabilities)
    return found.agg(
        F.struct(*[F.max(F.when(F.col("column_name") == c, F.col("quantiles"))).alias(c) for c in columns])
    ).scalar()
