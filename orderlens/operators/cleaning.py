"""Cleaning steps, each DataFrame to DataFrame, and the two complete pipelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import quantile_row
from ..schema import (
    CANCELLED_STATUSES,
    DROPPED_COLUMNS,
    IQR_FENCE,
    LATE_DELIVERY,
    OUTLIER_COLUMNS_A,
    OUTLIER_COLUMNS_B,
    TRIMMED_COLUMNS,
    TRIMMED_COLUMNS_SHORT,
)
from . import quality
from .duplicates import distinct_rows, row_fingerprint

DATE_COLUMNS = ("order_date", "shipping_date")
# Date layouts accepted by parsing, tried in this order.
DATE_FORMATS = ("M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def drop_columns(df: DataFrame, columns: Sequence[str] = DROPPED_COLUMNS) -> DataFrame:
    """Without the personal or unusable columns; absent ones are ignored."""
    return df.drop(*columns)


def fill_nulls(df: DataFrame, column: str = "customer_zipcode", value: int = -1) -> DataFrame:
    if column not in df.columns:
        return df
    return df.withColumn(column, F.coalesce(F.col(column).cast("int"), F.lit(value)))


def dedupe(
    df: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda df: df, told_by: Sequence[str] | None = None
) -> DataFrame:
    """Without exact repeats of a row; only rows with a repeated fingerprint are shuffled.

    The fingerprint is of all columns, or of those in ``told_by``: few columns that hardly ever agree in
    different rows, for rows that lie in a table already and need not be stored once more.
    """
    return distinct_rows(df, row_fingerprint(told_by) if told_by else None, store)


def parse_dates(
    df: DataFrame, columns: Sequence[str] = DATE_COLUMNS, formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Text to a zone-less timestamp; text in none of the formats becomes null."""
    text = set(name for name, kind in df.dtypes if kind == "string")

    def parse(column: str) -> Column:
        # Read as UTC and counted from the epoch, so the session's time zone plays no part.
        zoned = F.concat(F.col(column), F.lit(" +00:00"))
        read = F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f"{f} XXX")) for f in formats])
        return F.timestamp_add("SECOND", F.unix_seconds(read), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))

    parsed = {c: parse(c) for c in columns if c in text}
    return df.withColumns(parsed) if parsed else df


def filter_valid(df: DataFrame) -> DataFrame:
    """Rows with sales of at least zero and a positive quantity."""
    return df.filter((F.col("sales") >= 0) & (F.col("order_item_quantity") > 0))


def clip_days(df: DataFrame, column: str = "days_for_shipping_real") -> DataFrame:
    """Negative durations become zero; null stays null."""
    return df.withColumn(column, F.when(F.col(column) < 0, F.lit(0)).otherwise(F.col(column)))


def trim_text(df: DataFrame, columns: Sequence[str] = TRIMMED_COLUMNS) -> DataFrame:
    """Without white space at either end; inner blanks and nulls are kept."""
    blanks = F.lit(" \t\n\r\x0b\x0c")
    present = {c: F.trim(F.col(c), blanks) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def flag_cancelled(df: DataFrame) -> DataFrame:
    return df.withColumn("is_cancelled_or_fraud", F.col("order_status").isin(*CANCELLED_STATUSES))


def flag_iqr_outliers(df: DataFrame, columns: Sequence[str] = OUTLIER_COLUMNS_A) -> DataFrame:
    """``outlier_<column>``: outside the quartiles by more than 1.5 interquartile ranges.

    The quartiles of all columns are found together and reduced to one row; the rows
    themselves are only projected, not shuffled.
    """
    quartiles = quantile_row(df, columns, (0.25, 0.75))

    def outside(c: str) -> Column:
        value, q1, q3 = F.col(c).cast("double"), quartiles[c].getItem(0), quartiles[c].getItem(1)
        reach = IQR_FENCE * (q3 - q1)
        return F.coalesce((value < q1 - reach) | (value > q3 + reach), F.lit(False))

    return df.withColumns({f"outlier_{c}": outside(c) for c in columns})


def derive_calendar(df: DataFrame, column: str = "order_date") -> DataFrame:
    """Year, month, yyyy-MM, day name and the Monday/Sunday week of the order date."""
    day = F.col(column).cast("date")
    monday = F.date_trunc("week", F.col(column)).cast("date")
    return df.withColumns(
        {
            "order_year": F.year(day),
            "order_month": F.month(day),
            "order_year_month": F.date_format(column, "yyyy-MM"),
            "order_dow": F.date_format(column, "EEEE"),
            "order_week": F.concat_ws(
                "/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")
            ),
            "order_yyyymm": F.date_format(column, "yyyy-MM"),
        }
    )


def derive_dow_monthnum(df: DataFrame, column: str = "order_date") -> DataFrame:
    """Weekday from Monday = 0 and month number, as model inputs."""
    return df.withColumns({"order_dow_num": F.weekday(column), "order_month_num": F.month(column)})


def derive_is_late(df: DataFrame) -> DataFrame:
    """1 where the delivery status says late, otherwise 0 (also when the status is missing)."""
    late = F.coalesce(F.col("delivery_status") == LATE_DELIVERY, F.lit(False))
    return df.withColumn("is_late", late.cast("int"))


def derive_delay_days(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "shipping_delay_days", F.col("days_for_shipping_real") - F.col("days_for_shipment_scheduled")
    )


def order_level_view(df: DataFrame, order: Sequence[str], key: str = "order_id") -> DataFrame:
    """One row per order: its first line by ``order``.

    A running minimum of whole rows, combined before the shuffle, so even an order with a
    huge number of lines is one row per task.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*df.columns)


def clean_run(
    df: DataFrame, variant: str = "A", store: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """The raw extract through every step, in order.

    A: fill zip with -1, clip days, keep all rows, flag. B: fill zip with 0, drop rows
    with negative sales or no quantity, flag, status-based lateness.

    Removing duplicates reads the rows twice, and outlier flags read the outcome three times.
    ``store`` may write rows to a table and return it read back: it gets the rows with their
    fingerprints, and the few rows compared as a whole, so later reads need only their own columns.
    """
    return clean_unique(unique_rows(df, variant, store), variant)


def unique_rows(
    df: DataFrame,
    variant: str = "A",
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
    told_by: Sequence[str] | None = None,
) -> DataFrame:
    """The first steps of ``clean_run``: without dropped columns, zip codes filled, without repeats."""
    return dedupe(fill_nulls(drop_columns(df), value=-1 if variant == "A" else 0), store, told_by)


def clean_unique(df: DataFrame, variant: str = "A") -> DataFrame:
    """The steps of ``clean_run`` that follow ``unique_rows``."""
    df = parse_dates(df)
    if variant == "A":
        df = flag_cancelled(trim_text(clip_days(df)))
        df = flag_iqr_outliers(df, [c for c in OUTLIER_COLUMNS_A if c in df.columns])
        return derive_delay_days(derive_calendar(df).drop("order_week", "order_yyyymm"))
    df = filter_valid(trim_text(df, TRIMMED_COLUMNS_SHORT))
    df = flag_iqr_outliers(df, [c for c in OUTLIER_COLUMNS_B if c in df.columns])
    df = derive_calendar(df).drop("order_dow").withColumn("order_month", F.col("order_year_month"))
    cancelled = F.col("order_status").isin(*CANCELLED_STATUSES)
    df = derive_is_late(df.drop("order_year_month")).withColumn("is_cancelled", cancelled.cast("int"))
    return derive_delay_days(df)


def clean_rows(df: DataFrame, told_by: Sequence[str] | None = None) -> DataFrame:
    """The steps of variant A that look at one row, or at equal rows, alone: all but the outlier flags.

    A row's result never depends on rows of another year, so years can be refreshed by themselves.
    """
    unique = dedupe(fill_nulls(drop_columns(df)), told_by=told_by)
    flagged = flag_cancelled(trim_text(clip_days(parse_dates(unique))))
    return derive_delay_days(derive_calendar(flagged).drop("order_week", "order_yyyymm"))


def quality_log(
    raw: DataFrame, variant: str = "A", cleaned: DataFrame | None = None, unique: DataFrame | None = None
) -> DataFrame:
    """Every check of a cleaning run under one another: ``check, column_name, value``.

    Checks are taken at the point of the pipeline they belong to, on the raw rows, the
    deduplicated rows or the cleaned rows. Each check reads its input again, so on large
    data pass ``raw`` and ``cleaned`` as stored tables, and the ``unique_rows`` that were cleaned.
    """
    unique = unique_rows(raw, variant) if unique is None else unique
    parsed = parse_dates(unique)
    cleaned = clean_unique(unique, variant) if cleaned is None else cleaned
    statuses = quality.dq_status_counts(cleaned).select(
        F.col("column_name").alias("check"), F.col("status").alias("column_name"), F.col("n").cast("double").alias("value")
    )
    parts = [
        quality.dq_shape(raw).withColumn("check", F.lit("raw_shape")),
        quality.dq_grain_check(raw),
        quality.dq_missing_values(raw if variant == "A" else drop_columns(raw)),
        quality.dq_removed_rows(raw, unique),
        quality.dq_unparseable_dates(parsed),
        quality.dq_invalid_numeric(parsed, zero_quantity_is_bad=variant != "A"),
        quality.dq_cancelled_rows(cleaned),
        statuses,
        quality.dq_outlier_counts(cleaned),
        quality.dq_shape(cleaned).withColumn("check", F.lit("cleaned_shape")),
    ]
    return reduce(DataFrame.unionByName, parts)
