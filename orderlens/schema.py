"""Column names, schemas and fixed vocabularies of the order-line model."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels and thresholds that results are compared on.
CANCELLED_STATUSES = ("CANCELED", "SUSPECTED_FRAUD")
CANCELED = "CANCELED"
LATE_DELIVERY = "Late delivery"
ON_TIME_STATUSES = ("Shipping on time", "Advance shipping")
SHIPPING_CANCELED = "Shipping canceled"
IQR_FENCE = 1.5

# Personal or unusable raw columns removed by cleaning.
DROPPED_COLUMNS = (
    "customer_email",
    "customer_password",
    "customer_fname",
    "customer_lname",
    "customer_street",
    "product_description",
    "product_image",
    "order_zipcode",
)

# Text columns whose outer blanks are removed. The first eleven are the
# short list, all fifteen the full one.
TRIMMED_COLUMNS_SHORT = (
    "type",
    "delivery_status",
    "category_name",
    "customer_segment",
    "department_name",
    "market",
    "order_status",
    "order_region",
    "shipping_mode",
    "order_country",
    "customer_country",
)
TRIMMED_COLUMNS = TRIMMED_COLUMNS_SHORT + (
    "customer_city",
    "customer_state",
    "order_city",
    "order_state",
)

# Measures flagged for outliers in the two cleaning variants.
OUTLIER_COLUMNS_A = (
    "sales",
    "order_item_quantity",
    "order_item_discount",
    "days_for_shipping_real",
)
OUTLIER_COLUMNS_B = (
    "sales",
    "order_item_quantity",
    "days_for_shipping_real",
    "benefit_per_order",
)

# Measures described and correlated.
DESCRIBED_COLUMNS = OUTLIER_COLUMNS_A
CORRELATED_COLUMNS = (
    "days_for_shipping_real",
    "days_for_shipment_scheduled",
    "sales",
    "order_item_quantity",
    "order_item_discount",
    "order_item_profit_ratio",
    "late_delivery_risk",
)
CORRELATED_COLUMNS_SHORT = (
    "days_for_shipping_real",
    "days_for_shipment_scheduled",
    "sales",
    "order_item_quantity",
    "order_item_discount",
    "benefit_per_order",
)
CORRELATED_COLUMNS_WIDE = (
    "days_for_shipping_real",
    "days_for_shipment_scheduled",
    "sales",
    "order_item_quantity",
    "order_item_discount",
    "benefit_per_order",
    "order_item_profit_ratio",
    "shipping_delay_days",
)

DIM_PRODUCT_COLUMNS = (
    "product_card_id",
    "product_name",
    "category_name",
    "department_name",
    "product_price",
)
DIM_CUSTOMER_COLUMNS = (
    "customer_id",
    "customer_segment",
    "customer_country",
    "customer_state",
    "customer_city",
)

# Raw CSV header in file order, with the type each column is read as.
RAW_CSV_FIELDS = (
    ("Type", "string"),
    ("Days for shipping (real)", "int"),
    ("Days for shipment (scheduled)", "int"),
    ("Benefit per order", "double"),
    ("Sales per customer", "double"),
    ("Delivery Status", "string"),
    ("Late_delivery_risk", "int"),
    ("Category Id", "bigint"),
    ("Category Name", "string"),
    ("Customer City", "string"),
    ("Customer Country", "string"),
    ("Customer Email", "string"),
    ("Customer Fname", "string"),
    ("Customer Id", "bigint"),
    ("Customer Lname", "string"),
    ("Customer Password", "string"),
    ("Customer Segment", "string"),
    ("Customer State", "string"),
    ("Customer Street", "string"),
    ("Customer Zipcode", "double"),
    ("Department Id", "bigint"),
    ("Department Name", "string"),
    ("Latitude", "double"),
    ("Longitude", "double"),
    ("Market", "string"),
    ("Order City", "string"),
    ("Order Country", "string"),
    ("Order Customer Id", "bigint"),
    ("order date (DateOrders)", "string"),
    ("Order Id", "bigint"),
    ("Order Item Cardprod Id", "bigint"),
    ("Order Item Discount", "decimal(18,4)"),
    ("Order Item Discount Rate", "double"),
    ("Order Item Id", "bigint"),
    ("Order Item Product Price", "double"),
    ("Order Item Profit Ratio", "double"),
    ("Order Item Quantity", "bigint"),
    ("Sales", "decimal(18,2)"),
    ("Order Item Total", "double"),
    ("Order Profit Per Order", "double"),
    ("Order Region", "string"),
    ("Order State", "string"),
    ("Order Status", "string"),
    ("Order Zipcode", "double"),
    ("Product Card Id", "bigint"),
    ("Product Category Id", "bigint"),
    ("Product Description", "string"),
    ("Product Image", "string"),
    ("Product Name", "string"),
    ("Product Price", "double"),
    ("Product Status", "int"),
    ("shipping date (DateOrders)", "string"),
    ("Shipping Mode", "string"),
)


def snake_case(name: str) -> str:
    """Column label to identifier: ``Days for shipping (real)`` -> ``days_for_shipping_real``."""
    kept = "".join(ch if ch.isalnum() else " " if ch not in "()" else "" for ch in name)
    return "_".join(kept.lower().split())


def raw_csv_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in RAW_CSV_FIELDS))


def order_input_schema() -> T.StructType:
    """One order line to be scored, as known when the order is placed."""
    return T.StructType.fromDDL(
        "days_for_shipment_scheduled int, sales double, order_item_quantity int,"
        " order_item_discount_rate double, product_price double, shipping_mode string,"
        " order_region string, market string, category_name string, department_name string,"
        " customer_segment string, type string, order_dow string"
    )
