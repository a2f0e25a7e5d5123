"""Product and region lookups: a table over all names, or one name, ignoring case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_when, money, pct, ratio


def _matching(fact: DataFrame, column: str, name: str | None) -> DataFrame:
    return fact if name is None else fact.filter(F.lower(column) == name.lower())


def product_performance(fact: DataFrame, name: str | None = None) -> DataFrame:
    return (
        _matching(fact, "product_name", name)
        .groupBy(F.lower("product_name").alias("product_name"))
        .agg(
            money(F.sum("sales")).alias("total_sales"),
            F.sum("order_item_quantity").alias("total_units_sold"),
            F.round(F.avg("days_for_shipping_real"), 2).alias("avg_delivery_days"),
            pct(F.sum("late_delivery_risk"), F.count("late_delivery_risk")).alias("late_delivery_rate_pct"),
        )
    )


def region_kpis(fact: DataFrame, region: str | None = None) -> DataFrame:
    orders = (
        _matching(fact, "order_region", region)
        .groupBy(F.lower("order_region").alias("region"), "order_id")
        .agg(
            F.sum("sales").alias("sales"),
            count_when(F.col("late_delivery_risk") == 1).alias("late"),
            F.count("late_delivery_risk").alias("lines"),
            F.sum("days_for_shipping_real").alias("days"),
            F.count("days_for_shipping_real").alias("days_lines"),
        )
    )
    return orders.groupBy("region").agg(
        money(F.sum("sales")).alias("total_sales"),
        F.count("order_id").alias("total_orders"),
        pct(F.sum("late"), F.sum("lines")).alias("late_delivery_rate_pct"),
        ratio(F.sum("days"), F.sum("days_lines"), 2).alias("avg_delivery_days"),
    )
