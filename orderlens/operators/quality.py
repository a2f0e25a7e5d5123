"""Data-quality checks. Most return ``(check, column_name, value)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_when, ratio
from ..schema import CANCELLED_STATUSES
from .duplicates import count_repeated, row_fingerprint


def _long(row: DataFrame, check: str) -> DataFrame:
    """A one-row frame of numbers as (check, column_name, value)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in row.columns)
    return row.select(
        F.lit(check).alias("check"), F.expr(f"stack({len(row.columns)}, {pairs}) AS (column_name, value)")
    )


def dq_shape(df: DataFrame) -> DataFrame:
    return _long(df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns))), "shape")


def dq_grain_check(df: DataFrame, line_keys: Sequence[str] = ("order_id", "line_no")) -> DataFrame:
    """Rows, distinct orders and distinct line keys; how far counting rows overstates orders.

    Distinct counts run on rows already reduced to one per line key.
    """
    lines = df.groupBy(*line_keys).agg(F.count("*").alias("rows"))
    orders = lines.groupBy("order_id").agg(F.sum("rows").alias("rows"), F.count("*").alias("lines"))
    row = orders.agg(
        F.sum("rows").alias("n_rows"),
        F.count("order_id").alias("n_unique_orders"),
        F.sum("lines").alias("n_unique_line_keys"),
        F.round((ratio(F.sum("rows"), F.count("order_id")) - 1) * 100, 1).alias("overstatement_pct"),
        ratio(F.sum("rows"), F.count("order_id"), 3).alias("avg_items_per_order"),
    )
    return _long(row, "grain")


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The input unchanged; raises when a key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    if repeated.limit(1).count():
        raise ValueError(f"{', '.join(keys)} is not a unique key")
    return df


def dq_missing_values(df: DataFrame) -> DataFrame:
    """Null count per column, only columns that have any, from one pass over the data."""
    row = df.agg(*[count_when(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(row, "missing_values").filter(F.col("value") > 0).orderBy(F.col("value").desc(), "column_name")


def dq_duplicate_rows(df: DataFrame, told_by: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row: all rows less distinct rows.

    Rows are told apart by ``told_by``, if given, before any is compared as a whole: few columns that
    hardly ever agree in different rows, so the others are read only of rows that agree in these.
    """
    mark = row_fingerprint(told_by) if told_by else None
    return _long(count_repeated(df, mark).withColumnRenamed("n", "all_columns"), "duplicate_rows")


def dq_removed_rows(df: DataFrame, unique: DataFrame) -> DataFrame:
    """The row of ``dq_duplicate_rows`` where the rows without repeats are known: all rows less those."""
    signs = df.select(F.lit(1).alias("sign")).unionAll(unique.select(F.lit(-1).alias("sign")))
    return _long(signs.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("all_columns")), "duplicate_rows")


def dq_unparseable_dates(df: DataFrame, columns: Sequence[str] = ("order_date", "shipping_date")) -> DataFrame:
    """Null dates after parsing, per column and in total."""
    row = df.agg(*[count_when(F.col(c).isNull()).alias(c) for c in columns])
    return _long(row.withColumn("total", sum((F.col(c) for c in columns), F.lit(0))), "unparseable_dates")


def dq_invalid_numeric(df: DataFrame, zero_quantity_is_bad: bool = False) -> DataFrame:
    """Rows with negative sales, quantity, price or shipping days; optionally zero quantity too."""
    quantity = F.col("order_item_quantity")
    row = df.agg(
        count_when(F.col("sales") < 0).alias("sales"),
        count_when(quantity <= 0 if zero_quantity_is_bad else quantity < 0).alias("order_item_quantity"),
        count_when(F.col("product_price") < 0).alias("product_price"),
        count_when(F.col("days_for_shipping_real") < 0).alias("days_for_shipping_real"),
    )
    return _long(row, "invalid_numeric")


def dq_status_counts(df: DataFrame, columns: Sequence[str] = ("order_status", "delivery_status")) -> DataFrame:
    """Rows per value of each status column, all columns from one pass."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("n"))
        .select(F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, status)"), "n")
        .filter(F.col("status").isNotNull())
        .groupBy("column_name", "status")
        .agg(F.sum("n").alias("n"))
    )


def dq_cancelled_rows(df: DataFrame) -> DataFrame:
    cancelled: Column = F.col("order_status").isin(*CANCELLED_STATUSES)
    return _long(df.agg(count_when(cancelled).alias("order_status")), "cancelled_or_fraud_rows")


def dq_outlier_counts(flagged: DataFrame) -> DataFrame:
    names = [c for c in flagged.columns if c.startswith("outlier_")]
    return _long(
        flagged.agg(*[count_when(F.col(c)).alias(c.removeprefix("outlier_")) for c in names]), "iqr_outliers"
    )
