"""The order-line fact bound to a star of lineitem, orders, customer, nation, region and part.

Every dimension is LEFT-joined on its unique key, so the grain stays one lineitem row
whatever columns are asked for. That is what makes it safe to leave out the joins no
requested column needs: a query over sales and dates never shuffles ``part``. No
broadcast is forced; Spark broadcasts the small sides from their file sizes and sort-merge
joins the others, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .files import drop, listing

SALES = "CAST(l_extendedprice AS DECIMAL(18,2))"
QUANTITY = "CAST(l_quantity AS BIGINT)"
DISCOUNT = f"CAST({SALES} * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))"
TOTAL = f"CAST({SALES} - {DISCOUNT} AS DECIMAL(18,4))"
PRICE = "CAST(p_retailprice AS DECIMAL(18,2))"
BENEFIT = f"CAST({TOTAL} - {QUANTITY} * {PRICE} AS DECIMAL(18,4))"
SHIP_DAYS = "datediff(l_shipdate, o_orderdate)"
REAL_DAYS = f"pmod({SHIP_DAYS}, 7)"
SCHEDULED_DAYS = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END"
)
SHIPPING_MODE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'"
    " WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END"
)
ORDER_STATUS = (
    "CASE WHEN l_orderkey % 50 = 0 THEN 'CANCELED' WHEN l_orderkey % 50 = 1 THEN 'SUSPECTED_FRAUD'"
    " WHEN o_orderstatus = 'F' THEN 'COMPLETE' WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'PROCESSING' END"
)
DELIVERY_STATUS = (
    f"CASE WHEN l_orderkey % 50 IN (0, 1) THEN 'Shipping canceled'"
    f" WHEN {REAL_DAYS} > {SCHEDULED_DAYS} THEN 'Late delivery'"
    f" WHEN {REAL_DAYS} = {SCHEDULED_DAYS} THEN 'Shipping on time' ELSE 'Advance shipping' END"
)

# column -> (tables beyond lineitem it needs, expression)
FACT_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "order_id": ((), "l_orderkey"),
    "line_no": ((), "l_linenumber"),
    "product_card_id": ((), "l_partkey"),
    "order_customer_id": (("orders",), "o_custkey"),
    "customer_id": (("orders",), "o_custkey"),
    "sales": ((), SALES),
    "order_item_quantity": ((), QUANTITY),
    "order_item_discount_rate": ((), "l_discount + 0.0D"),
    "order_item_discount": ((), DISCOUNT),
    "order_item_total": ((), TOTAL),
    "product_price": (("part",), PRICE),
    "benefit_per_order": (("part",), BENEFIT),
    "order_item_profit_ratio": (("part",), f"CAST({BENEFIT} AS DOUBLE) / CAST({SALES} AS DOUBLE)"),
    "order_date": (("orders",), "o_orderdate"),
    "shipping_date": ((), "l_shipdate"),
    "raw_ship_days": (("orders",), SHIP_DAYS),
    "days_for_shipping_real": (("orders",), REAL_DAYS),
    "days_for_shipment_scheduled": (("orders",), SCHEDULED_DAYS),
    "shipping_delay_days": (("orders",), f"{REAL_DAYS} - {SCHEDULED_DAYS}"),
    "shipping_mode": (("orders",), SHIPPING_MODE),
    "order_status": (("orders",), ORDER_STATUS),
    "delivery_status": (("orders",), DELIVERY_STATUS),
    "late_delivery_risk": (("orders",), f"CASE WHEN {REAL_DAYS} > {SCHEDULED_DAYS} THEN 1 ELSE 0 END"),
    "is_late": (("orders",), f"CASE WHEN {DELIVERY_STATUS} = 'Late delivery' THEN 1 ELSE 0 END"),
    "customer_segment": (("orders", "customer"), "c_mktsegment"),
    "order_region": (("orders", "customer", "nation"), "n_name"),
    "order_country": (("orders", "customer", "nation"), "n_name"),
    "market": (("orders", "customer", "nation", "region"), "r_name"),
    "category_name": (("part",), "p_brand"),
    "department_name": (("part",), "p_type"),
    "product_name": (("part",), "p_name"),
    "type": ((), "l_returnflag"),
    "order_year_month": (("orders",), "date_format(o_orderdate, 'yyyy-MM')"),
    "order_dow": (("orders",), "date_format(o_orderdate, 'EEEE')"),
}

# What an uncleaned extract looks like, built by rule from the same rows: padded labels,
# two date layouts and unreadable dates, unclipped days, bad numbers, missing zip codes,
# personal columns and exact duplicate rows.
RAW_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    **{
        name: FACT_COLUMNS[name]
        for name in (
            "order_id",
            "line_no",
            "product_card_id",
            "order_customer_id",
            "order_item_discount_rate",
            "order_item_discount",
            "product_price",
            "benefit_per_order",
            "days_for_shipment_scheduled",
            "shipping_mode",
            "order_status",
            "delivery_status",
            "late_delivery_risk",
            "customer_segment",
            "market",
            "department_name",
            "product_name",
            "type",
        )
    },
    "sales": ((), f"CASE WHEN l_orderkey % 503 = 3 THEN -{SALES} ELSE {SALES} END"),
    "order_item_quantity": (
        (),
        f"CASE WHEN l_orderkey % 509 = 5 THEN 0L WHEN l_orderkey % 509 = 6 THEN -1L ELSE {QUANTITY} END",
    ),
    "days_for_shipping_real": (("orders",), SHIP_DAYS),
    "order_region": (
        ("orders", "customer", "nation"),
        "CASE WHEN l_linenumber % 3 = 0 THEN concat('  ', n_name, ' ') ELSE n_name END",
    ),
    "category_name": (("part",), "CASE WHEN l_linenumber % 2 = 0 THEN concat(p_brand, ' ') ELSE p_brand END"),
    "order_date": (
        ("orders",),
        "CASE WHEN l_orderkey % 211 = 0 THEN 'unknown'"
        " WHEN l_orderkey % 2 = 0 THEN date_format(o_orderdate, 'M/d/yyyy H:mm')"
        " ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END",
    ),
    "shipping_date": (
        (),
        "CASE WHEN l_orderkey % 223 = 0 THEN '' ELSE date_format(l_shipdate, 'M/d/yyyy H:mm') END",
    ),
    "customer_zipcode": (
        ("orders",),
        "CASE WHEN o_custkey % 97 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(10000 + o_custkey % 80000 AS DOUBLE) END",
    ),
    "customer_fname": (("orders", "customer"), "c_name"),
    "order_zipcode": (
        (),
        "CASE WHEN l_orderkey % 7 = 0 THEN CAST(10000 + l_orderkey % 80000 AS DOUBLE) END",
    ),
}

_JOIN_ORDER = ("orders", "customer", "nation", "region", "part")
_JOIN_KEYS = {
    "orders": ("l_orderkey", "o_orderkey"),
    "customer": ("o_custkey", "c_custkey"),
    "nation": ("c_nationkey", "n_nationkey"),
    "region": ("n_regionkey", "r_regionkey"),
    "part": ("l_partkey", "p_partkey"),
}
_LINE_COLUMNS = (
    "l_orderkey",
    "l_partkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_returnflag",
    "l_shipdate",
)
# What is stored with a line, and the tables that it comes from.
_ORDER_COLUMNS = (
    "o_custkey",
    "o_orderstatus",
    "o_orderdate",
    "o_orderpriority",
    "c_mktsegment",
    "n_name",
    "r_name",
)
_STORED_TABLES = {"orders", "customer", "nation", "region"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, lines: DataFrame, tables: set[str]) -> DataFrame:
    """Lines with the tables they need; what hangs on the order is joined to orders first, so lines move once."""

    def add(rows: DataFrame, name: str, other: DataFrame) -> DataFrame:
        left, right = _JOIN_KEYS[name]
        return rows.join(other, rows[left] == other[right], "left")

    result = lines
    if "orders" in tables:
        orders = read_table(spark, sf_dir, "orders")
        for name in _JOIN_ORDER[1:4]:
            if name in tables:
                orders = add(orders, name, read_table(spark, sf_dir, name))
        result = add(result, "orders", orders)
    if "part" in tables:
        result = add(result, "part", read_table(spark, sf_dir, "part"))
    return result


def _bound(
    spark: SparkSession, sf_dir: str, lines: DataFrame, known: dict, wanted: Iterable[str], distinct: bool = False
) -> DataFrame:
    """The columns ``wanted`` over ``lines``, joined with those tables that they need and the lines do not hold yet."""
    wanted = list(wanted)
    tables = {table for name in wanted for table in known[name][0]}
    if "o_custkey" in lines.columns:
        tables -= _STORED_TABLES
    if distinct:
        text = " ".join(known[name][1] for name in wanted)
        keys = {_JOIN_KEYS[table][0] for table in tables}
        used = {c for c in (*_LINE_COLUMNS, *_ORDER_COLUMNS) if re.search(rf"\b{c}\b", text)}
        lines = lines.select(*[c for c in lines.columns if c in used | keys]).distinct()
    rows = _joined(spark, sf_dir, lines, tables).select(*[F.expr(known[name][1]).alias(name) for name in wanted])
    return rows.distinct() if distinct else rows


def orders_fact(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """The cleaned fact, restricted to ``columns``; only the joins they need are made.

    ``distinct=True`` returns distinct rows and removes duplicates already among the
    lineitem columns in use, before any join (for dimension tables).
    """
    wanted = list(columns) if columns is not None else list(FACT_COLUMNS)
    return _bound(spark, sf_dir, read_table(spark, sf_dir, "lineitem"), FACT_COLUMNS, wanted, distinct)


def raw_orders(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The uncleaned extract, restricted to ``columns``."""
    wanted = list(columns) if columns is not None else list(RAW_COLUMNS)
    copies = F.expr("explode(array_repeat(0, CASE WHEN l_orderkey % 101 = 7 THEN 2 ELSE 1 END))")
    lines = read_table(spark, sf_dir, "lineitem").withColumn("_copy", copies)
    return _bound(spark, sf_dir, lines, RAW_COLUMNS, wanted)


# Where the joined lines of a session and data version are stored; the versions kept of one folder.
_FACTS: dict[tuple, str] = {}
_KEPT_FACTS = 2


def stored_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what hangs on their order, joined and written once per session and version of the folder's tables.

    Source columns are stored, not the fact's: they are a third as wide, and the join that makes them
    is written as it comes, lines of an order together. Readers prune columns, compute the fact's and join
    ``part`` where a column needs it. Of each folder the two latest versions stay, so queries planned
    before a change can still be run as far as they read no ``part``; older ones are removed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, listing(spark, sf_dir))
    if key not in _FACTS:
        path = scratch_path(spark, "fact")
        lines = read_table(spark, sf_dir, "lineitem").select(*_LINE_COLUMNS)
        _joined(spark, sf_dir, lines, _STORED_TABLES).select(*_LINE_COLUMNS, *_ORDER_COLUMNS).write.option("compression", "zstd").parquet(path)
        _FACTS[key] = path
        earlier = [k for k in _FACTS if k[:2] == key[:2]]
        for old in earlier[:-_KEPT_FACTS]:
            drop(spark, _FACTS.pop(old))
    return spark.read.parquet(_FACTS[key])


class Star:
    """A data folder and session; ``star.fact("sales", "order_region")`` reads what is named.

    With ``stored`` lines and orders are joined and written once, then only read, by all calls whose
    columns need an order; otherwise each call plans the joins its columns need.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.stored = stored

    def fact(self, *columns: str, distinct: bool = False) -> DataFrame:
        wanted = columns or tuple(FACT_COLUMNS)
        if self.stored and any("orders" in FACT_COLUMNS[name][0] for name in wanted):
            lines = stored_fact(self.spark, self.sf_dir)
        else:
            lines = read_table(self.spark, self.sf_dir, "lineitem")
        return _bound(self.spark, self.sf_dir, lines, FACT_COLUMNS, wanted, distinct)

    def raw(self, *columns: str) -> DataFrame:
        return raw_orders(self.spark, self.sf_dir, columns or None)
