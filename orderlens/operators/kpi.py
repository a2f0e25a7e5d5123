"""Headline indicators and BI measures.

Order-grain and line-grain figures come from one pass: lines are first summed per order
(map-side combining keeps a huge order small), then over all orders, so several distinct
counts never expand the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_when, double, money, pct, ratio
from ..schema import CANCELED, ON_TIME_STATUSES
from .business import monthly_sales


def _canceled() -> Column:
    return F.col("order_status") == CANCELED


def _risk(value: int) -> Column:
    return F.col("late_delivery_risk") == value


def _best_of(groups: DataFrame, column: str) -> DataFrame:
    """One row (name, sales, total): the group with the highest sales, first name on a tie.

    ``groups`` holds partial sums. The best group is a running minimum of (-sales, name)
    pairs, so there is no global sort and no window, however many groups there are.
    """
    sums = groups.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("sales").alias("sales"))
    best = F.min_by(F.struct(F.col(column).alias("name"), F.col("sales")), F.struct(-F.col("sales"), F.col(column)))
    return sums.agg(best.alias("best"), F.sum("sales").alias("total")).select(
        F.col("best.name").alias("name"), F.col("best.sales").alias("sales"), "total"
    )


def _best_of_each(fact: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The best group of each column as scalar structs, from one pass over the fact.

    Lines are summed to combinations of the columns first; all columns are vocabularies
    of tens of values, and Spark reuses that one shuffle for every column.
    """
    groups = fact.groupBy(*columns).agg(F.sum("sales").alias("sales"))
    return [_best_of(groups, column).select(F.struct("*").alias("top")).scalar() for column in columns]


def kpi_top_share(fact: DataFrame, column: str) -> DataFrame:
    top = _best_of(fact.select(column, "sales"), column)
    return top.select(
        F.col("name").alias(column),
        money(F.col("sales")).alias("sales"),
        pct(F.col("sales"), F.col("total")).alias("revenue_share_pct"),
    )


def kpi_sales_growth(fact: DataFrame, drop_tail_months: int = 4) -> DataFrame:
    """Growth from the first to the last month, leaving out ``drop_tail_months`` at the end."""
    latest_first = Window.orderBy(F.col("order_month").desc())
    kept = (
        monthly_sales(fact)
        .filter(F.col("order_month").isNotNull())
        .withColumn("age", F.row_number().over(latest_first))
        .filter(F.col("age") > drop_tail_months)
    )
    ends = kept.agg(
        F.min("order_month").alias("first_month"),
        F.max("order_month").alias("last_month"),
        F.min_by("month_sales", "order_month").alias("first"),
        F.max_by("month_sales", "order_month").alias("last"),
    )
    return ends.select(
        "first_month",
        "last_month",
        money(F.col("first")).alias("first_month_sales"),
        money(F.col("last")).alias("last_month_sales"),
        pct(F.col("last") - F.col("first"), F.col("first")).alias("sales_growth_pct"),
    )


def kpi_on_time_rate(fact: DataFrame) -> DataFrame:
    """On-time share of lines by risk flag and by delivery status.

    The flag counts cancelled shipments as on time; the status does not.
    """
    row = fact.agg(
        pct(count_when(_risk(0)), F.count("*")).alias("risk_flag"),
        pct(count_when(F.col("delivery_status").isin(*ON_TIME_STATUSES)), F.count("*")).alias("delivery_status"),
    )
    return row.select(
        F.expr("stack(2, 'risk_flag', risk_flag, 'delivery_status', delivery_status) AS (definition, value)")
    )


def kpi_cancellation_rate(fact: DataFrame) -> DataFrame:
    """Cancelled share of lines, and of distinct orders."""
    orders = fact.groupBy("order_id").agg(
        count_when(_canceled()).alias("canceled_lines"), F.count("*").alias("lines")
    )
    row = orders.agg(
        pct(F.sum("canceled_lines"), F.sum("lines")).alias("line_items"),
        pct(count_when((F.col("canceled_lines") > 0) & F.col("order_id").isNotNull()), F.count("order_id")).alias(
            "orders"
        ),
    )
    return row.select(F.expr("stack(2, 'line_items', line_items, 'orders', orders) AS (definition, value)"))


def _order_rollup(fact: DataFrame) -> DataFrame:
    return fact.groupBy("order_id").agg(
        F.sum("sales").alias("sales"),
        F.sum("order_item_quantity").alias("units"),
        F.sum("order_item_discount").alias("discount"),
        F.count("order_item_discount").alias("discount_lines"),
        F.sum("days_for_shipping_real").alias("days"),
        F.count("days_for_shipping_real").alias("days_lines"),
        F.count("*").alias("lines"),
        count_when(_risk(0)).alias("no_risk"),
        count_when(_risk(1)).alias("risk"),
        count_when(F.col("is_late") == 1).alias("late"),
        count_when(F.col("delivery_status").isin(*ON_TIME_STATUSES)).alias("on_time"),
        count_when(_canceled()).alias("canceled"),
    )


def kpi_summary(fact: DataFrame, drop_tail_months: int = 4) -> DataFrame:
    """One row of indicators; late and on-time by risk flag, cancellation by line."""
    base = _order_rollup(fact).agg(
        money(F.sum("sales")).alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        F.sum("units").alias("total_units_sold"),
        ratio(F.sum("sales"), F.count("order_id"), 2).alias("average_order_value"),
        ratio(F.sum("days"), F.sum("days_lines"), 2).alias("average_delivery_time_days"),
        pct(F.sum("no_risk"), F.sum("lines")).alias("on_time_delivery_rate_pct"),
        pct(F.sum("risk"), F.sum("lines")).alias("late_delivery_rate_pct"),
        pct(F.sum("canceled"), F.sum("lines")).alias("cancellation_rate_pct"),
    )
    category, region, department = _best_of_each(fact, ("category_name", "order_region", "department_name"))
    growth = kpi_sales_growth(fact, drop_tail_months).select("sales_growth_pct").scalar()
    return base.select(
        "*",
        growth.alias("sales_growth_rate_pct_first_vs_last_complete_month"),
        category["name"].alias("top_category"),
        pct(category["sales"], category["total"]).alias("top_category_revenue_share_pct"),
        region["name"].alias("top_region"),
        pct(region["sales"], region["total"]).alias("top_region_revenue_share_pct"),
        department["name"].alias("top_department_proxy_supplier"),
    )


def kpi_summary_alt(fact: DataFrame, drop_tail_months: int = 1) -> DataFrame:
    """The second set of definitions: late and on-time by status, cancellation by order."""
    base = _order_rollup(fact).agg(
        money(F.sum("sales")).alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        F.sum("units").alias("total_units_sold"),
        ratio(F.sum("sales"), F.count("order_id"), 2).alias("average_order_value"),
        ratio(F.sum("discount"), F.sum("discount_lines"), 2).alias("average_discount_per_item"),
        ratio(F.sum("days"), F.sum("days_lines"), 2).alias("average_delivery_time_days"),
        pct(F.sum("on_time"), F.sum("lines")).alias("on_time_delivery_rate_pct"),
        pct(F.sum("late"), F.sum("lines")).alias("late_delivery_rate_pct"),
        pct(count_when((F.col("canceled") > 0) & F.col("order_id").isNotNull()), F.count("order_id")).alias("cancellation_rate_pct"),
    )
    category, region = _best_of_each(fact, ("category_name", "order_region"))
    growth = kpi_sales_growth(fact, drop_tail_months).select("sales_growth_pct").scalar()
    return base.select(
        "*",
        growth.alias("sales_growth_rate_pct_first_vs_last_month"),
        category["name"].alias("top_category"),
        region["name"].alias("top_region"),
    )


def _order_grain(fact: DataFrame, dims: Sequence[str]) -> DataFrame:
    return fact.groupBy(*dims, "order_id").agg(
        F.sum("sales").alias("sales"),
        F.sum("order_item_quantity").alias("units"),
        F.count("*").alias("lines"),
        count_when(_risk(1)).alias("late"),
        F.sum("days_for_shipping_real").alias("days"),
        F.count("days_for_shipping_real").alias("days_lines"),
        F.sum("days_for_shipment_scheduled").alias("scheduled"),
        F.count("days_for_shipment_scheduled").alias("scheduled_lines"),
        F.sum("shipping_delay_days").alias("delay"),
        F.count("shipping_delay_days").alias("delay_lines"),
        count_when(_canceled()).alias("canceled"),
    )


_SUMMED = ("sales", "units", "lines", "late", "days", "days_lines", "scheduled", "scheduled_lines", "delay", "delay_lines")


def _measures(orders: Column, canceled_orders: Column) -> list[Column]:
    """The dashboard measures over sums of ``_SUMMED``; rates as fractions of one."""

    def mean(total: str, lines: str) -> Column:
        return ratio(F.sum(total), F.sum(lines), 6)

    late = ratio(F.sum("late"), F.sum("lines"))
    return [
        money(F.sum("sales")).alias("revenue"),
        orders.alias("orders"),
        F.sum("units").alias("units"),
        ratio(F.sum("sales"), orders, 2).alias("avg_order_value"),
        F.round(late, 6).alias("late_pct"),
        F.round(1 - late, 6).alias("on_time_pct"),
        mean("days", "days_lines").alias("avg_days"),
        mean("scheduled", "scheduled_lines").alias("avg_scheduled"),
        mean("delay", "delay_lines").alias("avg_delay"),
        ratio(canceled_orders, orders, 6).alias("cancellation_pct"),
    ]


def bi_measures_by_dim(fact: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The dashboard measures for any slicer columns; rates as fractions of one."""
    orders = _order_grain(fact, dims)
    return orders.groupBy(*dims).agg(*_measures(F.count("order_id"), count_when(F.col("canceled") > 0)))


def bi_measures_cube(fact: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The dashboard measures for every subset of the slicer columns, from one pass over the fact.

    ``level`` names the columns of a row's subset, comma-joined; columns that are not in it are null.
    Lines are summed to orders and values once. An order is counted once in each group that any of
    its lines falls into, whatever the level: where its values stand together, each is marked, for
    every subset, if no earlier one agrees in that subset. Marks add up, so all levels follow from the
    sums of the finest one, whose rows are as many as the combinations of the dimensions' values.
    An order's values are bounded by those combinations, however many lines it has.
    """
    subsets = [tuple(d for i, d in enumerate(dims) if not k >> i & 1) for k in range(1 << len(dims))]
    rows = _order_grain(fact, dims).groupBy("order_id").agg(F.collect_list(F.struct(*dims, *_SUMMED, "canceled")).alias("rows"))

    def agrees(row: Column, subset: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda other: reduce(lambda a, b: a & b, [other[d].eqNullSafe(row[d]) for d in subset], F.lit(True))

    def marked(row: Column, place: Column) -> Column:
        earlier = F.slice("rows", F.lit(1), place)
        known = F.col("order_id").isNotNull()
        marks = []
        canceled = known & (row["canceled"] > 0)
        for k, subset in enumerate(subsets):
            first = known & ~F.exists(earlier, agrees(row, subset))
            first_canceled = canceled & ~F.exists(F.filter(earlier, lambda o: o["canceled"] > 0), agrees(row, subset))
            marks += [first.cast("int").alias(f"orders_{k}"), first_canceled.cast("int").alias(f"canceled_{k}")]
        return F.struct(*[row[c].alias(c) for c in (*dims, *_SUMMED)], *marks)

    counters = [f"{name}_{k}" for k in range(len(subsets)) for name in ("orders", "canceled")]
    finest = (
        rows.select(F.explode(F.transform("rows", marked)).alias("r"))
        .select("r.*")
        .groupBy(*dims)
        .agg(*[F.sum(c).alias(c) for c in (*_SUMMED, *counters)])
    )
    # Of each subset only its own counters hold: bit i of the grouping id tells whether column i is left out.
    level = F.col("_level")
    place = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in subset): k for k, subset in enumerate(subsets)}

    def counter(name: str) -> Column:
        chain = F.when(F.lit(False), F.lit(0).cast("long"))
        for number, k in place.items():
            chain = chain.when(level == number, F.col(f"{name}_{k}"))
        return chain

    sets = [[F.col(d) for d in subset] for subset in subsets]
    summed = finest.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_level"), *[F.sum(c).alias(c) for c in (*_SUMMED, *counters)]
    )
    names = F.concat_ws(",", *[F.when(F.shiftright(level, len(dims) - 1 - i) % 2 == 0, F.lit(d)) for i, d in enumerate(dims)])
    shown = summed.select(names.alias("level"), *dims, "_level", *_SUMMED, counter("orders").alias("n"), counter("canceled").alias("c"))
    return shown.groupBy("level", *dims).agg(*_measures(F.sum("n"), F.sum("c")))


def bi_mom_growth_calendar(fact: DataFrame) -> DataFrame:
    """Revenue growth against the previous calendar month, blank where that has no sales."""
    months = monthly_sales(fact).withColumn("month", F.to_date(F.concat("order_month", F.lit("-01"))))
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter(F.col("a").isNotNull())
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    previous = F.lag("month_sales").over(Window.orderBy("month"))
    filled = calendar.join(months, "month", "left").withColumn("previous", previous)
    return filled.select(
        F.date_format("month", "yyyy-MM").alias("month"),
        money(F.col("month_sales")).alias("revenue"),
        money(F.col("previous")).alias("prev_month_revenue"),
        F.round(
            F.try_divide(double(F.col("month_sales") - F.col("previous")), double(F.col("previous"))), 6
        ).alias("growth"),
    )


def monthly_kpi(fact: DataFrame) -> DataFrame:
    """Pre-aggregated monthly table for reporting."""
    month = F.date_format("order_date", "yyyy-MM").alias("order_year_month")
    orders = fact.groupBy(month, "order_id").agg(
        F.sum("sales").alias("sales"),
        F.sum("order_item_quantity").alias("units"),
        F.count("*").alias("lines"),
        count_when(_risk(1)).alias("late"),
    )
    return orders.groupBy("order_year_month").agg(
        money(F.sum("sales")).alias("revenue"),
        F.count("order_id").alias("orders"),
        F.sum("units").alias("units"),
        F.sum("lines").alias("n_line_items"),
        pct(F.sum("late"), F.sum("lines")).alias("late_pct"),
    )
