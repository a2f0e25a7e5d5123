"""Business questions over the fact.

Where a question joins the fact with a dimension, the fact is first summed to the join
key. Summation distributes over the join, so the result is the same as joining line by
line (also if a key has several dimension rows), but the shuffle carries one row per key
and task instead of all lines, and a best-selling product cannot overload one join task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_when, double, money, pct, ratio, share_of_total, year_month

def _late() -> Column:
    return F.col("late_delivery_risk") == 1


def monthly_sales(fact: DataFrame) -> DataFrame:
    """Exact decimal sales per ``order_month`` (yyyy-MM); a bounded number of rows."""
    return fact.groupBy(year_month("order_date").alias("order_month")).agg(F.sum("sales").alias("month_sales"))


def q01_totals(fact: DataFrame) -> DataFrame:
    orders = fact.groupBy("order_id").agg(
        F.sum("sales").alias("sales"), F.sum("order_item_quantity").alias("units")
    )
    return orders.agg(
        money(F.sum("sales")).alias("total_sales"),
        F.count("order_id").alias("total_orders"),
        F.sum("units").alias("total_units_sold"),
        ratio(F.sum("sales"), F.count("order_id"), 2).alias("avg_order_value"),
    )


def _product_sales(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    per_key = fact.groupBy("product_card_id").agg(F.sum("sales").alias("sales"))
    dim = dim_product.select("product_card_id", "category_name", "product_name")
    return (
        per_key.join(dim, "product_card_id")
        .groupBy("category_name", "product_name")
        .agg(F.sum("sales").alias("sales"))
    )


def q02_top_products(fact: DataFrame, dim_product: DataFrame, n: int = 20) -> DataFrame:
    """Best-selling products with their sales rank.

    The rank of a row depends only on rows above it, so it is computed on the top ``n``
    alone instead of in a window over every product.
    """
    top = (
        _product_sales(fact, dim_product)
        .orderBy(F.col("sales").desc(), "category_name", "product_name")
        .limit(n)
    )
    return top.select(
        "category_name",
        "product_name",
        money(F.col("sales")).alias("product_sales"),
        F.rank().over(Window.orderBy(F.col("sales").desc())).cast("bigint").alias("sales_rank"),
    )


def q03_region_revenue(fact: DataFrame) -> DataFrame:
    regions = fact.groupBy("order_region").agg(F.sum("sales").alias("sales"))
    return regions.select(
        "order_region",
        money(F.col("sales")).alias("region_sales"),
        share_of_total("sales").alias("pct_of_total_sales"),
    ).orderBy(F.col("region_sales").desc(), "order_region")


def q04_segment_sales(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    per_order = fact.groupBy("order_customer_id", "order_id").agg(F.sum("sales").alias("sales"))
    dim = dim_customer.select("customer_id", "customer_segment")
    segments = (
        per_order.join(dim, per_order.order_customer_id == dim.customer_id)
        .groupBy("customer_segment", "order_id")
        .agg(F.sum("sales").alias("sales"))
        .groupBy("customer_segment")
        .agg(F.sum("sales").alias("sales"), F.count("order_id").alias("segment_orders"))
    )
    return segments.select(
        "customer_segment",
        money(F.col("sales")).alias("segment_sales"),
        "segment_orders",
        F.dense_rank().over(Window.orderBy(F.col("sales").desc())).cast("bigint").alias("segment_rank"),
    )


def q05_shipping_mode_mix(fact: DataFrame) -> DataFrame:
    modes = fact.groupBy("shipping_mode").agg(F.count("*").alias("n_line_items"))
    return modes.select(
        "shipping_mode", "n_line_items", share_of_total("n_line_items").alias("pct_of_line_items")
    ).orderBy(F.col("n_line_items").desc(), "shipping_mode")


def q06_avg_shipping_duration(fact: DataFrame) -> DataFrame:
    real, scheduled = F.col("days_for_shipping_real"), F.col("days_for_shipment_scheduled")
    return (
        fact.groupBy("shipping_mode")
        .agg(
            F.round(F.avg(real), 2).alias("avg_actual_days"),
            F.round(F.avg(scheduled), 2).alias("avg_scheduled_days"),
            F.round(F.avg(real - scheduled), 2).alias("avg_delay_days"),
        )
        .orderBy(F.col("avg_actual_days").desc(), "shipping_mode")
    )


def q07_pct_late(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count("*").alias("total_line_items"),
        count_when(_late()).alias("late_line_items"),
        pct(count_when(_late()), F.count("*")).alias("pct_late"),
    )


def q08_region_late_rate(fact: DataFrame, min_rows: int = 500, n: int = 10) -> DataFrame:
    """Regions with the highest late rate among those with more than ``min_rows`` lines."""
    return (
        fact.groupBy("order_region")
        .agg(
            F.count("*").alias("n_line_items"),
            pct(count_when(_late()), F.count("*")).alias("late_delivery_rate_pct"),
        )
        .filter(F.col("n_line_items") > min_rows)
        .orderBy(F.col("late_delivery_rate_pct").desc(), "order_region")
        .limit(n)
    )


def q09_high_sales_late_products(
    fact: DataFrame, dim_product: DataFrame, min_late: float = 50, n: int = 15
) -> DataFrame:
    """Product names selling above the mean per product id, with a late rate above ``min_late``.

    Both comparisons use the rounded figures that are shown.
    """
    per_key = fact.groupBy("product_card_id").agg(
        F.sum("sales").alias("sales"), count_when(_late()).alias("late"), F.count("*").alias("lines")
    )
    mean_sales = per_key.agg((double(F.sum("sales")) / F.count("*")).alias("mean_sales")).scalar()
    names = (
        per_key.join(dim_product.select("product_card_id", "product_name"), "product_card_id")
        .groupBy("product_name")
        .agg(F.sum("sales").alias("sales"), F.sum("late").alias("late"), F.sum("lines").alias("n_line_items"))
        .select(
            "product_name",
            money(F.col("sales")).alias("total_sales"),
            pct(F.col("late"), F.col("n_line_items")).alias("late_rate_pct"),
            "n_line_items",
        )
    )
    return (
        names.filter((F.col("total_sales") > mean_sales) & (F.col("late_rate_pct") > min_late))
        .orderBy(F.col("total_sales").desc(), "product_name")
        .limit(n)
    )


def q10_mom_growth(fact: DataFrame) -> DataFrame:
    """Change against the previous month that has sales."""
    previous = F.lag("month_sales").over(Window.orderBy("order_month"))
    months = monthly_sales(fact).withColumn("previous", previous)
    return months.select(
        "order_month",
        money(F.col("month_sales")).alias("total_sales"),
        money(F.col("previous")).alias("prev_month_sales"),
        pct(F.col("month_sales") - F.col("previous"), F.col("previous")).alias("mom_growth_pct"),
    )


def q11_top3_per_category(fact: DataFrame, dim_product: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("category_name").orderBy(F.col("sales").desc(), "product_name")
    return (
        _product_sales(fact, dim_product)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= k)
        .select(
            "category_name",
            "product_name",
            money(F.col("sales")).alias("total_sales"),
            F.col("rn").cast("bigint").alias("rn"),
        )
    )


def q12_cumulative_revenue(fact: DataFrame) -> DataFrame:
    by_month = Window.orderBy("order_month")
    running = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly_sales(fact).select(
        "order_month",
        money(F.col("month_sales")).alias("total_sales"),
        money(F.sum("month_sales").over(running)).alias("cumulative_sales"),
        money(F.lead("month_sales").over(by_month)).alias("next_month_sales"),
    )
