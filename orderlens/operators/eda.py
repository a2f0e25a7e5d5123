"""The aggregates behind the exploratory charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money, pct, year_month
from ..functions.ordered import quantile_row, quantiles_of_counts, value_counts
from ..schema import IQR_FENCE

_QUARTILES = (0.25, 0.5, 0.75)


def sales_by(fact: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Sales per group, highest first; with ``n`` the top groups only."""
    result = (
        fact.groupBy(column)
        .agg(F.sum("sales").alias("_sales"))
        .orderBy(F.col("_sales").desc(), column)
    )
    if n is not None:
        result = result.limit(n)
    return result.select(column, money(F.col("_sales")).alias("sales"))


def eda_monthly_sales(fact: DataFrame) -> DataFrame:
    return fact.groupBy(year_month("order_date").alias("order_year_month")).agg(
        money(F.sum("sales")).alias("sales")
    )


def eda_shipping_mode_stats(fact: DataFrame) -> DataFrame:
    return fact.groupBy("shipping_mode").agg(
        F.count("*").alias("n_line_items"), F.round(F.avg("days_for_shipping_real"), 6).alias("avg_days")
    )


def eda_late_rate_by_region(fact: DataFrame, n: int = 10) -> DataFrame:
    late = pct(F.sum("late_delivery_risk"), F.count("late_delivery_risk"), 6)
    return (
        fact.groupBy("order_region")
        .agg(late.alias("late_pct"))
        .orderBy(F.col("late_pct").desc(), "order_region")
        .limit(n)
    )


def eda_late_rate_top_volume(fact: DataFrame, n: int = 10) -> DataFrame:
    """Late share (by status) of the ``n`` regions with most lines.

    Volume and lateness come from the same aggregate, so the fact is not joined back.
    """
    return (
        fact.filter(F.col("order_region").isNotNull())
        .groupBy("order_region")
        .agg(F.count("*").alias("_lines"), pct(F.sum("is_late"), F.count("is_late"), 6).alias("late_pct"))
        .orderBy(F.col("_lines").desc(), "order_region")
        .limit(n)
        .drop("_lines")
    )


def eda_segment_sales(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("customer_segment", "order_id")
        .agg(F.sum("sales").alias("sales"))
        .groupBy("customer_segment")
        .agg(money(F.sum("sales")).alias("sales"), F.count("order_id").alias("orders"))
    )


def eda_order_status(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("order_status")
        .agg(F.count("*").alias("n_line_items"))
        .orderBy(F.col("n_line_items").desc(), "order_status")
    )


def eda_late_trend(fact: DataFrame) -> DataFrame:
    return fact.groupBy(year_month("order_date").alias("order_year_month")).agg(
        pct(F.sum("late_delivery_risk"), F.count("late_delivery_risk"), 6).alias("late_pct")
    )


def histogram(fact: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins included.

    A constant column has all its rows in bin 0.
    """
    value = F.col(column).cast("double")
    limits = fact.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = limits["lo"], limits["hi"]
    width = (hi - lo) / bins
    position = F.coalesce(F.floor(F.try_divide(value - lo, width)), F.lit(0))
    counts = (
        fact.filter(F.col(column).isNotNull())
        .select(F.least(position, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    every_bin = fact.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every_bin.join(counts, "bin", "left").select(
        "bin",
        F.round(lo + F.col("bin") * width, 6).alias("lo"),
        F.round(lo + (F.col("bin") + 1) * width, 6).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def boxplot(fact: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Five-number summary, whiskers at the last value inside 1.5 IQR, and outlier count.

    With ``by`` everything after the first shuffle works on distinct values with counts.
    """
    group = [by] if by else []
    value = fact.select(*group, F.col(column).cast("double").alias("_v"))
    if by:
        rows = value_counts(value, "_v", group)
        rows = rows.join(quantiles_of_counts(rows, "_v", _QUARTILES, group).drop("n"), by)
    else:
        rows = value.withColumns({"quantiles": quantile_row(value, ["_v"], _QUARTILES)["_v"], "n": F.lit(1)})
    q1, q3 = F.col("quantiles").getItem(0), F.col("quantiles").getItem(2)
    reach = IQR_FENCE * (q3 - q1)
    inside = (F.col("_v") >= q1 - reach) & (F.col("_v") <= q3 + reach)
    quartiles = F.first("quantiles", ignorenulls=True)
    return rows.groupBy(*group).agg(
        F.min("_v").alias("min"),
        quartiles.getItem(0).alias("q1"),
        quartiles.getItem(1).alias("median"),
        quartiles.getItem(2).alias("q3"),
        F.max("_v").alias("max"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("n_outliers"),
    )


def eda_scatter_sample(
    fact: DataFrame, identity: Sequence[str], n: int = 5000, seed: int = 42
) -> DataFrame:
    """``n`` lines in an order given by a seeded hash of each line, whatever the partitioning.

    Each task keeps its ``n`` first lines, so only those travel.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])
    return (
        fact.withColumn("_key", F.md5(text))
        .orderBy("_key", *identity)
        .limit(n)
        .select("order_item_discount_rate", F.round("order_item_profit_ratio", 6).alias("order_item_profit_ratio"), "late_delivery_risk")
    )
