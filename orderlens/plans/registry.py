"""Every operator as a query over a data folder.

A query names the fact columns it uses, so only the joins and scans they need are planned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    business,
    cleaning,
    dimensions,
    eda,
    inventory,
    kpi,
    lookup,
    ml_data,
    ml_metrics,
    ml_models,
    quality,
    statistics,
    supplier,
    timeseries as ts,
)
from ..operators.forecast_store import ForecastStore
from ..operators.holt_winters import MOVING_AVERAGE, NAIVE
from ..schema import (
    CORRELATED_COLUMNS,
    CORRELATED_COLUMNS_SHORT,
    CORRELATED_COLUMNS_WIDE,
    DESCRIBED_COLUMNS,
    DIM_PRODUCT_COLUMNS,
    DROPPED_COLUMNS,
    OUTLIER_COLUMNS_A,
    RAW_CSV_FIELDS,
    snake_case,
)
from ..session import ensure_skew_handling, scratch_path
from ..sources import files
from ..sources import star as star_module
from ..sources.star import FACT_COLUMNS, RAW_COLUMNS, Star
from ..sources.versions import VersionedTables, refresh_partitions

# Test-data parameters: the last month is partial.
LAST_COMPLETE_MONTH = "2001-07"
MONTH_CUTOFF = "2001-07-31"
WEEK_CUTOFF = "2001-07-29"
TEST_MONTHS = 6
TEST_WEEKS = 12
HORIZON = 6

QUERIES: dict[str, Callable[[Star], DataFrame]] = {}


def query(function: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(function: Callable[[Star], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_skew_handling(spark)
            return function(Star(spark, sf_dir.rstrip("/"), stored=True))

        return run

    return {name: bound(function) for name, function in QUERIES.items()}


KEYS = ("order_id", "line_no", "product_card_id")


# Where tables that several queries share are stored, by session, version of the data and name.
_SHARED: dict[tuple, str] = {}


def _version(star: Star) -> tuple:
    """The session and the files of the folder's tables with their sizes and times: other data, another key."""
    return (star.spark.sparkContext.applicationId, star.sf_dir, files.listing(star.spark, star.sf_dir))


def _once(star: Star, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per session and version of the folder's tables, then only read."""
    key = (*_version(star), name)
    if key not in _SHARED:
        path = scratch_path(star.spark, name)
        build().write.option("compression", "zstd").parquet(path)
        _SHARED[key] = path
    return star.spark.read.parquet(_SHARED[key])


def _raw(star: Star) -> DataFrame:
    """The uncleaned extract, joined and written once."""
    return _once(star, "raw", star.raw)


def _dim_product(star: Star) -> DataFrame:
    return dimensions.dim_product(star.fact(*DIM_PRODUCT_COLUMNS, distinct=True))


def _dim_customer(star: Star) -> DataFrame:
    return dimensions.dim_customer(star.fact("customer_id", "customer_segment", distinct=True))


# --- sources and sinks -------------------------------------------------------------------


@query
def read_csv_raw(star: Star) -> DataFrame:
    """Raw extract written in its original layout, then read with the declared schema."""
    renamed = {"order_date_dateorders": "order_date", "shipping_date_dateorders": "shipping_date"}
    sources = [(name, kind, renamed.get(snake_case(name), snake_case(name))) for name, kind in RAW_CSV_FIELDS]
    raw = star.raw(*[column for _, _, column in sources if column in RAW_COLUMNS])
    shaped = raw.select(
        *[
            (F.col(column) if column in RAW_COLUMNS else F.lit(None)).cast(kind).alias(name)
            for name, kind, column in sources
        ]
    )
    path = scratch_path(star.spark, "raw_csv")
    # Text with line breaks is read file by file in any case, so packed files cost no task.
    files.write_csv(shaped, path, encoding="ISO-8859-1", compression="gzip")
    return files.read_csv_raw(star.spark, path).select(
        "order_id", "product_card_id", "order_date", "order_region", "sales", "customer_zipcode", "customer_fname"
    )


_STORED = (*KEYS, "sales", "order_item_quantity", "order_date", "order_region", "days_for_shipping_real")


def _stored_fact(star: Star) -> dict[str, str]:
    stored = star.fact(*_STORED).withColumn("order_year", F.year("order_date"))
    return files.write_clean(stored, scratch_path(star.spark, "clean"))


@query
def read_csv_clean(star: Star) -> DataFrame:
    schema = star.fact(*_STORED).withColumn("order_year", F.year("order_date")).schema
    path = scratch_path(star.spark, "clean_csv")
    files.write_csv(star.fact(*_STORED).withColumn("order_year", F.year("order_date")), path)
    return files.read_csv_clean(star.spark, path, schema)


@query
def read_parquet_clean(star: Star) -> DataFrame:
    path = _stored_fact(star)["parquet"]
    return (
        files.read_parquet_clean(star.spark, path, ["order_year", "sales", "order_item_quantity"])
        .groupBy("order_year")
        .agg(F.count("*").alias("n"), F.sum("sales").cast("double").alias("sales"), F.sum("order_item_quantity").alias("units"))
    )


@query
def write_clean(star: Star) -> DataFrame:
    """Both written forms, compared row for row by the caller."""
    paths = _stored_fact(star)
    parquet = star.spark.read.parquet(paths["parquet"])
    csv = files.read_csv_clean(star.spark, paths["csv"], star.fact(*_STORED).withColumn("order_year", F.year("order_date")).schema)
    columns = [*KEYS, "order_year", "sales"]
    return (
        parquet.select(F.lit("parquet").alias("form"), *columns)
        .unionByName(csv.select(F.lit("csv").alias("form"), *columns))
        .groupBy("form", "order_year")
        .agg(F.count("*").alias("n"), F.sum("sales").cast("double").alias("sales"))
    )


@query
def fact_view(star: Star) -> DataFrame:
    files.fact_view(star.fact("order_id", "sales", "order_date", "market"))
    return star.spark.sql(
        "SELECT market, count(*) AS n, count(DISTINCT order_id) AS orders,"
        " CAST(sum(sales) AS DOUBLE) AS sales FROM orders_fact GROUP BY market"
    )


@query
def dim_product(star: Star) -> DataFrame:
    return _dim_product(star).withColumn("product_price", F.col("product_price").cast("double"))


@query
def dim_customer(star: Star) -> DataFrame:
    return _dim_customer(star)


@query
def dim_date(star: Star) -> DataFrame:
    return dimensions.dim_date(star.fact("order_date"))


@query
def dim_key_check(star: Star) -> DataFrame:
    """Product names with several ids: names are no key, ids are."""
    return dimensions.dim_key_check(_dim_product(star), "product_name")


@query
def write_query_results(star: Star) -> DataFrame:
    results = {name: QUERIES[name](star) for name in QUERIES if name[:1] == "q" and name[1:3].isdigit()}
    return files.write_query_results(star.spark, results, scratch_path(star.spark, "sql_results"))


@query
def query_preview(star: Star) -> DataFrame:
    return files.query_preview(q03_region_revenue(star), [F.col("region_sales").desc(), "order_region"])


@query
def write_json_results(star: Star) -> DataFrame:
    path = scratch_path(star.spark, "kpi_json")
    row = kpi_summary(star)
    files.write_json(row, path)
    return star.spark.read.schema(row.schema).json(path)


@query
def results_catalog(star: Star) -> DataFrame:
    rates = ("value", "definition")
    parts = [
        kpi_on_time_rate(star).select(F.lit("kpi_on_time").alias("section"), F.col(rates[1]).alias("metric"), rates[0]),
        kpi_cancellation_rate(star).select(
            F.lit("kpi_cancellation").alias("section"), F.col(rates[1]).alias("metric"), rates[0]
        ),
        stats_mean_ci(star).select(
            F.lit("mean_delay").alias("section"),
            F.expr("stack(3, 'mean', mean, 'ci_lower', ci_lower, 'ci_upper', ci_upper) AS (metric, value)"),
        ),
        stats_chi_square(star).select(
            F.lit("segment_vs_late").alias("section"),
            F.expr("stack(2, 'chi2_statistic', chi2_statistic, 'dof', CAST(dof AS DOUBLE)) AS (metric, value)"),
        ),
        ts_model_comparison(star).filter(F.col("model").isin(NAIVE, MOVING_AVERAGE)).select(
            F.concat(F.lit("forecast_"), "model").alias("section"),
            F.expr("stack(2, 'mae', mae, 'rmse', rmse) AS (metric, value)"),
        ),
        ml_metrics_query(star).select(F.lit("late_model").alias("section"), "metric", "value"),
    ]
    return files.results_catalog(parts)


def _model_metrics(star: Star) -> DataFrame:
    """Held-out quality of the four trained models, written once."""
    return _once(star, "model-metrics", lambda: ml_metrics.ml_metrics(_all_predictions(star)))


@query
def evidence_catalog(star: Star) -> DataFrame:
    """Indicators, tests, forecasts and trained models in one long table."""
    forecasts = _forecasts(star).forward(HORIZON).filter("series_key = 'all'")
    parts = [
        files.as_evidence(kpi_summary(star), "kpi"),
        files.as_evidence(kpi_summary_alt(star), "kpi_alt"),
        files.as_evidence(stats_mean_ci(star), "mean_delay"),
        files.as_evidence(stats_chi_square(star), "segment_vs_late"),
        files.as_evidence(stats_anova(star), "days_by_shipping_mode"),
        files.as_evidence(ts_model_comparison(star), "forecast_test", ["model"]),
        files.as_evidence(forecasts, "forecast", ["series_key", "period"]),
        files.as_evidence(_best(star), "forecast_best", ["series_key"]),
        files.as_evidence(_model_metrics(star), "late_model", ["model", "metric"]),
    ]
    return files.results_catalog(parts)


@query
def evidence_catalog_names(star: Star) -> DataFrame:
    """Sections of the catalog with their numbers of metrics and of values."""
    found = evidence_catalog(star)
    return found.groupBy("section").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


def _star_tables(star: Star) -> dict[str, DataFrame]:
    return {
        "fact_orders": star.fact(),
        "dim_product": _dim_product(star),
        "dim_customer": _dim_customer(star),
        "monthly_kpi": monthly_kpi(star),
        "inventory": inventory_profile(star),
        "supplier": supplier_scorecard_ranked(star),
        "forecast": _forward(star),
        "model_comparison": _model_metrics(star),
    }


@query
def export_star_schema(star: Star) -> DataFrame:
    """Publishes the reporting tables as one version and returns the row count of each as a reader finds it."""
    store = VersionedTables(star.spark, scratch_path(star.spark, "star"))
    store.publish(_star_tables(star))
    version = store.manifest()
    counts = [
        store.read(name, manifest=version).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        for name in version.tables
    ]
    return reduce(DataFrame.unionByName, counts)


#: Last year of the first delivery in ``clean_refresh``.
FIRST_DELIVERY = 1997


@query
def clean_refresh(star: Star) -> DataFrame:
    """The extract delivered in two parts, cleaned by year: what each year holds and whether the second part rewrote it."""
    raw = star.raw()
    dated = cleaning.parse_dates(raw.withColumn("_day", F.col("order_date")), ["_day"]).withColumn("_year", F.year("_day"))
    later = F.coalesce(F.col("_year") > FIRST_DELIVERY, F.lit(False))
    inputs = scratch_path(star.spark, "deliveries")
    # Both deliveries in one pass over the joined rows; the second is not looked at before its turn.
    delivered = dated.withColumn("_delivery", F.when(later, "second").otherwise("first")).select(*raw.columns, "_delivery")
    delivered.write.option("compression", "zstd").partitionBy("_delivery").parquet(inputs)
    listed = [f for f in files.listing(star.spark, inputs) if f[0].endswith(".parquet")]
    store = VersionedTables(star.spark, scratch_path(star.spark, "clean-store"), compression="zstd")
    done = {}
    for parts in (("first",), ("first", "second")):
        found = [f for f in listed if any(f"/_delivery={part}/" in f[0] for part in parts)]
        done = refresh_partitions(
            store,
            "clean",
            found,
            lambda paths: star.spark.read.schema(raw.schema).parquet(*paths),
            lambda rows: cleaning.clean_rows(rows, _KEPT_IDENTITY),
            "order_year",
            # Repeats lie in the year of their first, so a file's years need no comparison of rows.
            place=lambda rows: cleaning.derive_calendar(cleaning.parse_dates(rows, ["order_date"])),
        )
    rewritten = F.coalesce(F.col("order_year").cast("string"), F.lit("none")).isin(done["written"])
    cleaned = store.read("clean")
    return cleaned.groupBy("order_year", rewritten.alias("rewritten")).agg(
        F.count("*").alias("n"), F.sum("sales").cast("double").alias("sales"), F.count_if("is_cancelled_or_fraud").alias("cancelled")
    )


@query
def monthly_kpi(star: Star) -> DataFrame:
    return kpi.monthly_kpi(
        star.fact("order_id", "order_date", "sales", "order_item_quantity", "late_delivery_risk")
    )


# --- cleaning and quality ----------------------------------------------------------------


@query
def dq_shape(star: Star) -> DataFrame:
    return quality.dq_shape(star.raw())


@query
def dq_grain_check(star: Star) -> DataFrame:
    return quality.dq_grain_check(star.fact("order_id", "line_no"))


@query
def dq_missing_values(star: Star) -> DataFrame:
    return quality.dq_missing_values(star.raw())


@query
def clean_drop_columns(star: Star) -> DataFrame:
    return cleaning.drop_columns(star.raw(*KEYS, "customer_fname", "order_zipcode"))


@query
def clean_fill_nulls(star: Star) -> DataFrame:
    return cleaning.fill_nulls(star.raw(*KEYS, "customer_zipcode"))


#: Raw columns that come from the line alone.
_LINE_IDENTITY = tuple(c for c in RAW_COLUMNS if not RAW_COLUMNS[c][0])
#: Those that cleaning keeps.
_KEPT_IDENTITY = tuple(c for c in _LINE_IDENTITY if c not in DROPPED_COLUMNS)
_DEDUPE = (*KEYS, "sales", "order_item_quantity", "order_date", "order_region")


@query
def dq_duplicate_rows(star: Star) -> DataFrame:
    """Lines are told apart by their own columns first; only those that repeat are joined and compared as a whole."""
    return quality.dq_duplicate_rows(star.raw(), _LINE_IDENTITY)


@query
def clean_dedupe(star: Star) -> DataFrame:
    deduped = cleaning.dedupe(star.raw(*_DEDUPE))
    return deduped.withColumn("sales", F.col("sales").cast("double"))


_LINE_ORDER = ("line_no", "product_card_id", "sales", "order_item_quantity", "shipping_date")


@query
def order_level_view(star: Star) -> DataFrame:
    first = cleaning.order_level_view(star.fact("order_id", *_LINE_ORDER, "order_status"), _LINE_ORDER)
    return first.withColumn("sales", F.col("sales").cast("double"))


@query
def clean_parse_dates(star: Star) -> DataFrame:
    return cleaning.parse_dates(star.raw(*KEYS, "order_date", "shipping_date"))


@query
def dq_unparseable_dates(star: Star) -> DataFrame:
    return quality.dq_unparseable_dates(cleaning.parse_dates(star.raw("order_date", "shipping_date")))


_NUMERIC_CHECKED = ("sales", "order_item_quantity", "product_price", "days_for_shipping_real")


@query
def dq_invalid_numeric(star: Star) -> DataFrame:
    return quality.dq_invalid_numeric(star.raw(*_NUMERIC_CHECKED))


@query
def dq_invalid_numeric_strict(star: Star) -> DataFrame:
    return quality.dq_invalid_numeric(star.raw(*_NUMERIC_CHECKED), zero_quantity_is_bad=True)


@query
def clean_filter_valid(star: Star) -> DataFrame:
    valid = cleaning.filter_valid(star.raw(*KEYS, "sales", "order_item_quantity"))
    return valid.withColumn("sales", F.col("sales").cast("double"))


@query
def clean_clip_days(star: Star) -> DataFrame:
    return cleaning.clip_days(star.raw(*KEYS, "days_for_shipping_real"))


@query
def clean_trim_text(star: Star) -> DataFrame:
    return cleaning.trim_text(star.raw(*KEYS, "order_region", "category_name"))


@query
def dq_status_counts(star: Star) -> DataFrame:
    return quality.dq_status_counts(star.fact("order_status", "delivery_status"))


@query
def flag_cancelled(star: Star) -> DataFrame:
    return cleaning.flag_cancelled(star.fact(*KEYS, "order_status"))


def _flagged(star: Star) -> DataFrame:
    return cleaning.flag_iqr_outliers(star.fact(*KEYS, *OUTLIER_COLUMNS_A)).drop(*OUTLIER_COLUMNS_A)


@query
def flag_iqr_outliers(star: Star) -> DataFrame:
    return _flagged(star)


@query
def iqr_outlier_summary(star: Star) -> DataFrame:
    return statistics.iqr_outlier_summary(star.fact("benefit_per_order"), "benefit_per_order")


@query
def outlier_rates(star: Star) -> DataFrame:
    return statistics.outlier_rates(
        cleaning.flag_iqr_outliers(
            star.fact(*OUTLIER_COLUMNS_A, "benefit_per_order"), [*OUTLIER_COLUMNS_A, "benefit_per_order"]
        )
    )


@query
def derive_calendar(star: Star) -> DataFrame:
    return cleaning.derive_calendar(star.fact(*KEYS, "order_date"))


@query
def derive_dow_monthnum(star: Star) -> DataFrame:
    return cleaning.derive_dow_monthnum(star.fact(*KEYS, "order_date"))


@query
def derive_is_late(star: Star) -> DataFrame:
    return cleaning.derive_is_late(star.fact(*KEYS, "delivery_status"))


@query
def derive_delay_days(star: Star) -> DataFrame:
    return cleaning.derive_delay_days(
        star.fact(*KEYS, "days_for_shipping_real", "days_for_shipment_scheduled")
    )


_DECIMALS = ("sales", "order_item_discount", "product_price", "benefit_per_order")


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in _DECIMALS if c in df.columns})


@query
def clean_run(star: Star) -> DataFrame:
    return _doubles(cleaning.clean_run(star.raw(), "A", lambda df: files.stored(df, "marked_rows")))


@query
def clean_run_alt(star: Star) -> DataFrame:
    return _doubles(cleaning.clean_run(star.raw(), "B", lambda df: files.stored(df, "marked_rows")))


@query
def quality_log(star: Star) -> DataFrame:
    """The log of the first variant, over stored raw and cleaned tables."""
    return _quality_log(star, "A")


@query
def quality_log_alt(star: Star) -> DataFrame:
    """The log of the second variant."""
    return _quality_log(star, "B")


def _quality_log(star: Star, variant: str) -> DataFrame:
    raw = _raw(star)
    unique = cleaning.unique_rows(raw, variant, told_by=_KEPT_IDENTITY)
    cleaned = files.stored(cleaning.clean_unique(unique, variant), "cleaned")
    return cleaning.quality_log(raw, variant, cleaned, unique)


# --- business queries --------------------------------------------------------------------


@query
def q01_totals(star: Star) -> DataFrame:
    return business.q01_totals(star.fact("order_id", "sales", "order_item_quantity"))


@query
def q02_top_products(star: Star) -> DataFrame:
    return business.q02_top_products(star.fact("product_card_id", "sales"), _dim_product(star))


@query
def q03_region_revenue(star: Star) -> DataFrame:
    return business.q03_region_revenue(star.fact("order_region", "sales"))


@query
def q04_segment_sales(star: Star) -> DataFrame:
    return business.q04_segment_sales(star.fact("order_customer_id", "order_id", "sales"), _dim_customer(star))


@query
def q05_shipping_mode_mix(star: Star) -> DataFrame:
    return business.q05_shipping_mode_mix(star.fact("shipping_mode"))


@query
def q06_avg_shipping_duration(star: Star) -> DataFrame:
    return business.q06_avg_shipping_duration(
        star.fact("shipping_mode", "days_for_shipping_real", "days_for_shipment_scheduled")
    )


@query
def q07_pct_late(star: Star) -> DataFrame:
    return business.q07_pct_late(star.fact("late_delivery_risk"))


@query
def q08_region_late_rate(star: Star) -> DataFrame:
    return business.q08_region_late_rate(star.fact("order_region", "late_delivery_risk"))


@query
def q09_high_sales_late_products(star: Star) -> DataFrame:
    return business.q09_high_sales_late_products(
        star.fact("product_card_id", "sales", "late_delivery_risk"), _dim_product(star)
    )


@query
def q10_mom_growth(star: Star) -> DataFrame:
    return business.q10_mom_growth(star.fact("order_date", "sales"))


@query
def q11_top3_per_category(star: Star) -> DataFrame:
    return business.q11_top3_per_category(star.fact("product_card_id", "sales"), _dim_product(star))


@query
def q12_cumulative_revenue(star: Star) -> DataFrame:
    return business.q12_cumulative_revenue(star.fact("order_date", "sales"))


# --- indicators --------------------------------------------------------------------------

_KPI = (
    "order_id",
    "sales",
    "order_item_quantity",
    "order_item_discount",
    "days_for_shipping_real",
    "late_delivery_risk",
    "is_late",
    "delivery_status",
    "order_status",
    "order_date",
    "category_name",
    "order_region",
    "department_name",
)


@query
def kpi_summary(star: Star) -> DataFrame:
    return kpi.kpi_summary(star.fact(*_KPI), drop_tail_months=4)


@query
def kpi_summary_alt(star: Star) -> DataFrame:
    return kpi.kpi_summary_alt(star.fact(*_KPI), drop_tail_months=1)


@query
def kpi_on_time_rate(star: Star) -> DataFrame:
    return kpi.kpi_on_time_rate(star.fact("late_delivery_risk", "delivery_status"))


@query
def kpi_cancellation_rate(star: Star) -> DataFrame:
    return kpi.kpi_cancellation_rate(star.fact("order_id", "order_status"))


@query
def kpi_sales_growth(star: Star) -> DataFrame:
    fact = star.fact("order_date", "sales")
    return reduce(
        DataFrame.unionByName,
        [kpi.kpi_sales_growth(fact, n).withColumn("drop_tail_months", F.lit(n)) for n in (1, 4)],
    )


@query
def kpi_top_category_share(star: Star) -> DataFrame:
    return kpi.kpi_top_share(star.fact("category_name", "sales"), "category_name")


@query
def kpi_top_region_share(star: Star) -> DataFrame:
    return kpi.kpi_top_share(star.fact("order_region", "sales"), "order_region")


_MEASURED = (
    "order_id",
    "sales",
    "order_item_quantity",
    "late_delivery_risk",
    "days_for_shipping_real",
    "days_for_shipment_scheduled",
    "shipping_delay_days",
    "order_status",
)


@query
def bi_measures_by_dim(star: Star) -> DataFrame:
    dims = ("market", "shipping_mode")
    return kpi.bi_measures_by_dim(star.fact(*dims, *_MEASURED), dims)


@query
def bi_measures_cube(star: Star) -> DataFrame:
    """All subsets of region, segment and month."""
    dims = ("order_region", "customer_segment", "order_year_month")
    return kpi.bi_measures_cube(star.fact(*dims, *_MEASURED), dims)


@query
def bi_measures_cube_products(star: Star) -> DataFrame:
    """Subsets of columns of the product, which an order's lines differ in."""
    dims = ("category_name", "type")
    return kpi.bi_measures_cube(star.fact(*dims, *_MEASURED), dims)


@query
def bi_mom_growth_calendar(star: Star) -> DataFrame:
    return kpi.bi_mom_growth_calendar(star.fact("order_date", "sales"))


# --- suppliers and inventory -------------------------------------------------------------


@query
def supplier_scorecard(star: Star) -> DataFrame:
    return supplier.supplier_scorecard(star.fact("department_name", "sales", "late_delivery_risk"))


@query
def supplier_scorecard_ranked(star: Star) -> DataFrame:
    return supplier.supplier_scorecard_ranked(
        star.fact("department_name", "sales", "days_for_shipping_real", "is_late")
    )


def _product_months(star: Star, key: str) -> DataFrame:
    """One row per product and month, written once; every indicator of products reads it."""
    columns = (key, "order_id", "order_item_quantity", "sales", "order_date")
    return _once(star, f"product-months-{key}", lambda: inventory.product_months(star.fact(*columns), key))


def _profile(star: Star, key: str, zero_fill: bool = True) -> DataFrame:
    """One row per product, written once: bands look for quantiles in it and then read it."""
    months = _product_months(star, key)
    name = f"profile-{key}-{zero_fill}"
    return _once(star, name, lambda: inventory.demand_profile_of(months, key, LAST_COMPLETE_MONTH, zero_fill))


@query
def demand_profile(star: Star) -> DataFrame:
    return _profile(star, "product_card_id")


@query
def demand_profile_active_months(star: Star) -> DataFrame:
    return _profile(star, "product_card_id", zero_fill=False)


@query
def mover_class(star: Star) -> DataFrame:
    return inventory.mover_class(demand_profile(star)).select("product_card_id", "avg_units_per_month", "mover_class")


@query
def stockout_risk_proxy(star: Star) -> DataFrame:
    return inventory.stockout_risk_proxy(demand_profile(star)).select(
        "product_card_id", "demand_coefficient_of_variation", "stockout_risk_proxy"
    )


@query
def inventory_profile(star: Star) -> DataFrame:
    return inventory.with_demand_bands(_profile(star, "product_name"))


@query
def inventory_summary(star: Star) -> DataFrame:
    return inventory.inventory_summary(inventory_profile(star), "product_name")


@query
def product_demand_cv(star: Star) -> DataFrame:
    months = _product_months(star, "product_name")
    return _once(star, "product-cv", lambda: inventory.product_demand_cv_of(months))


@query
def mover_class_qty(star: Star) -> DataFrame:
    return inventory.mover_class_qty(product_demand_cv(star)).select("product_name", "total_qty_sold", "mover_class")


@query
def stockout_risk_flag(star: Star) -> DataFrame:
    return inventory.stockout_risk_flag(product_demand_cv(star)).select(
        "product_name", "demand_cv", "mover_class", "stockout_risk_flag"
    )


@query
def top_fast_movers(star: Star) -> DataFrame:
    return inventory.top_fast_movers(inventory.stockout_risk_flag(product_demand_cv(star)))


@query
def bottom_slow_movers(star: Star) -> DataFrame:
    return inventory.bottom_slow_movers(inventory.mover_class_qty(product_demand_cv(star)))


# --- exploratory feeds -------------------------------------------------------------------


@query
def eda_monthly_sales(star: Star) -> DataFrame:
    return eda.eda_monthly_sales(star.fact("order_date", "sales"))


@query
def eda_top_categories(star: Star) -> DataFrame:
    return eda.sales_by(star.fact("category_name", "sales"), "category_name", 12)


@query
def eda_region_sales(star: Star) -> DataFrame:
    return eda.sales_by(star.fact("order_region", "sales"), "order_region")


@query
def eda_shipping_mode_stats(star: Star) -> DataFrame:
    return eda.eda_shipping_mode_stats(star.fact("shipping_mode", "days_for_shipping_real"))


@query
def eda_days_boxplot(star: Star) -> DataFrame:
    return eda.boxplot(star.fact("shipping_mode", "days_for_shipping_real"), "days_for_shipping_real", "shipping_mode")


@query
def eda_discount_histogram(star: Star) -> DataFrame:
    return eda.histogram(star.fact("order_item_discount"), "order_item_discount", 50)


@query
def eda_days_histogram(star: Star) -> DataFrame:
    return eda.histogram(star.fact("days_for_shipping_real"), "days_for_shipping_real", 20)


@query
def eda_late_rate_by_region(star: Star) -> DataFrame:
    return eda.eda_late_rate_by_region(star.fact("order_region", "late_delivery_risk"))


@query
def eda_late_rate_top_volume(star: Star) -> DataFrame:
    return eda.eda_late_rate_top_volume(star.fact("order_region", "is_late"))


@query
def eda_segment_sales(star: Star) -> DataFrame:
    return eda.eda_segment_sales(star.fact("customer_segment", "order_id", "sales"))


@query
def eda_correlation(star: Star) -> DataFrame:
    return statistics.stats_correlation(star.fact(*CORRELATED_COLUMNS_WIDE), CORRELATED_COLUMNS_WIDE, digits=6)


@query
def eda_sales_boxplot(star: Star) -> DataFrame:
    return eda.boxplot(star.fact("sales"), "sales")


@query
def eda_order_status(star: Star) -> DataFrame:
    return eda.eda_order_status(star.fact("order_status"))


@query
def eda_late_trend(star: Star) -> DataFrame:
    return eda.eda_late_trend(star.fact("order_date", "late_delivery_risk"))


@query
def eda_scatter_sample(star: Star) -> DataFrame:
    return eda.eda_scatter_sample(
        star.fact(*ml_data.IDENTITY, "order_item_discount_rate", "order_item_profit_ratio", "late_delivery_risk"),
        ml_data.IDENTITY,
    )


# --- statistics --------------------------------------------------------------------------


@query
def stats_describe(star: Star) -> DataFrame:
    return statistics.stats_describe(star.fact(*DESCRIBED_COLUMNS))


@query
def stats_correlation(star: Star) -> DataFrame:
    return statistics.stats_correlation(star.fact(*CORRELATED_COLUMNS), CORRELATED_COLUMNS)


@query
def stats_correlation_alt(star: Star) -> DataFrame:
    """The six columns of the second variant."""
    return statistics.stats_correlation(star.fact(*CORRELATED_COLUMNS_SHORT), CORRELATED_COLUMNS_SHORT)


@query
def stats_anova(star: Star) -> DataFrame:
    return statistics.stats_anova(star.fact("shipping_mode", "days_for_shipping_real"))


@query
def stats_chi_square(star: Star) -> DataFrame:
    return statistics.stats_chi_square(star.fact("customer_segment", "late_delivery_risk"))


@query
def stats_crosstab(star: Star) -> DataFrame:
    return statistics.stats_crosstab(star.fact("customer_segment", "late_delivery_risk"))


@query
def stats_mean_ci(star: Star) -> DataFrame:
    return statistics.stats_mean_ci(star.fact("shipping_delay_days"))


# --- forecasting -------------------------------------------------------------------------


def _units(star: Star, key: str | None = None) -> DataFrame:
    return star.fact("order_date", "order_item_quantity", *([key] if key else []))


def _months(star: Star, key: str | None = None) -> DataFrame:
    """Units per month of each series, stored."""
    return _once(star, f"months-{key}", lambda: ts.monthly_series(_units(star, key), key))


def _weeks(star: Star, key: str | None = None) -> DataFrame:
    """Units per week of each series, stored."""
    return _once(star, f"weeks-{key}", lambda: ts.ts_weekly_demand(_units(star, key), key))


def _complete_months(star: Star, key: str | None = None) -> DataFrame:
    return ts.ts_exclude_tail(_months(star, key), MONTH_CUTOFF)


def _month_split(star: Star) -> DataFrame:
    return ts.ts_time_split(_complete_months(star, "category_name"), TEST_MONTHS)


@query
def ts_monthly_demand(star: Star) -> DataFrame:
    return ts.ts_monthly_demand(star.fact("category_name", "order_date", "order_item_quantity", "sales"), "category_name")


@query
def ts_weekly_demand(star: Star) -> DataFrame:
    return _weeks(star, "product_name")


@query
def ts_exclude_tail(star: Star) -> DataFrame:
    return ts.ts_exclude_tail(_weeks(star), WEEK_CUTOFF)


@query
def ts_excluded_periods(star: Star) -> DataFrame:
    return ts.ts_excluded_periods(_months(star), MONTH_CUTOFF)


@query
def ts_time_split(star: Star) -> DataFrame:
    return _month_split(star)


@query
def ts_naive_forecast(star: Star) -> DataFrame:
    return ts.ts_naive_forecast(_month_split(star))


@query
def ts_moving_average_forecast(star: Star) -> DataFrame:
    return ts.ts_moving_average_forecast(_month_split(star))


@query
def ts_holt_winters(star: Star) -> DataFrame:
    return ts.ts_holt_winters(_month_split(star), TEST_MONTHS)


@query
def ts_holt_winters_weekly(star: Star) -> DataFrame:
    """Weekly fits of every product, and of the company total as one series among them."""
    series = ts.ts_exclude_tail(_weeks(star, "product_name").unionByName(_weeks(star)), WEEK_CUTOFF)
    return ts.ts_holt_winters(ts.ts_time_split(series, TEST_WEEKS), TEST_WEEKS, "week")


# Where the fitted states of a session and folder are kept, and the version of the data they are of.
_STATES: dict[tuple, str] = {}
_STATES_OF: dict[str, tuple] = {}


def _forecasts(star: Star) -> ForecastStore:
    """States of all categories and of the total; new data refits the series that it changes."""
    place = (star.spark.sparkContext.applicationId, star.sf_dir)
    root = _STATES.setdefault(place, scratch_path(star.spark, "forecast-states"))
    store = ForecastStore(star.spark, root)
    if _STATES_OF.get(root) != _version(star):
        store.refresh(_complete_months(star, "category_name").unionByName(_complete_months(star)))
        _STATES_OF[root] = _version(star)
    return store


@query
def ts_refit_forward(star: Star) -> DataFrame:
    return _forecasts(star).forward(HORIZON).filter("series_key <> 'all'")


def _category_accuracy(star: Star) -> DataFrame:
    split = _month_split(star)
    return ts.ts_accuracy(ts.ts_naive_forecast(split).unionByName(ts.ts_moving_average_forecast(split)))


def _tested(star: Star) -> DataFrame:
    """Test months of every category under all three models, stored."""
    return _once(star, "month-tests", lambda: ts.ts_model_predictions(_month_split(star), TEST_MONTHS))


def _best(star: Star) -> DataFrame:
    return ts.ts_best_model(ts.ts_accuracy(_tested(star)))


def _forward(star: Star) -> DataFrame:
    """The months to come of every category by its best model, stored."""
    return _once(star, "forward", lambda: ts.ts_forward(_complete_months(star, "category_name"), _best(star), HORIZON))


@query
def ts_accuracy(star: Star) -> DataFrame:
    return _category_accuracy(star)


@query
def ts_accuracy_models(star: Star) -> DataFrame:
    return ts.ts_accuracy(_tested(star))


@query
def ts_best_model(star: Star) -> DataFrame:
    """The best of all three models per category."""
    return _best(star)


@query
def ts_best_baseline(star: Star) -> DataFrame:
    """The better of the two models without a fit."""
    baselines = _tested(star).filter(F.col("model").isin(NAIVE, MOVING_AVERAGE))
    return ts.ts_best_model(ts.ts_accuracy(baselines))


@query
def ts_model_comparison(star: Star) -> DataFrame:
    """Accuracy of all three models on the company total."""
    return ts.ts_accuracy(ts.ts_model_predictions(ts.ts_time_split(_complete_months(star), TEST_MONTHS), TEST_MONTHS))


@query
def ts_forward_best(star: Star) -> DataFrame:
    """The months to come of every category, by its best model refitted on all months."""
    return _forward(star)


@query
def ts_planning_signal(star: Star) -> DataFrame:
    """The next four months by the best model against the last four."""
    return ts.ts_planning_signal(_complete_months(star, "category_name"), _forward(star).drop("model"))


@query
def ts_planning_signal_naive(star: Star) -> DataFrame:
    """The held-out months by their naive forecast against the last four training months."""
    split = _month_split(star)
    train = split.filter(F.col("part") == "train").select("series_key", "period", "y")
    return ts.ts_planning_signal(train, ts.ts_naive_forecast(split).select("series_key", "period", "y_hat"))


@query
def ts_actual_vs_forecast(star: Star) -> DataFrame:
    """Train, test, every model on the test months, and the months to come."""
    return ts.ts_actual_vs_forecast(_month_split(star), [_tested(star)], _forward(star))


@query
def ts_actual_vs_forecast_baselines(star: Star) -> DataFrame:
    """The rows of the feed that no fit has a part in."""
    return ts_actual_vs_forecast(star).filter(F.col("series").isin("actual_train", "actual_test", NAIVE, MOVING_AVERAGE))


@query
def ts_forward_periods(star: Star) -> DataFrame:
    """Which rows of the chart feed come from fits: series, month and kind, without their values."""
    fitted = ts_actual_vs_forecast(star).filter(~F.col("series").isin("actual_train", "actual_test", NAIVE, MOVING_AVERAGE))
    ahead = F.col("series").startswith("forward_")
    kind = F.when(ahead, "forward").otherwise(F.col("series"))
    return fitted.select("series_key", "period", kind.alias("kind"), F.col("value").isNotNull().alias("has_value"))


@query
def ts_refit_forward_periods(star: Star) -> DataFrame:
    """Series, month and model of the stored forecasts."""
    return _forecasts(star).forward(HORIZON).select("series_key", "period", "model", F.col("y_hat").isNotNull().alias("has_value"))


@query
def ts_flatline_check(star: Star) -> DataFrame:
    return ts.ts_flatline_check(_weeks(star, "category_name"))


# --- late-delivery models ----------------------------------------------------------------


def _ml_fact(star: Star, variant: str = "A") -> DataFrame:
    derived = {"order_dow_num", "order_month_num"}
    extra = {"A": [], "B": ["order_date", "delivery_status"]}[variant]
    wanted = [*ml_data.IDENTITY, *ml_data.feature_columns(variant), ml_data.TARGET[variant], *extra]
    return star.fact(*dict.fromkeys(c for c in wanted if c in FACT_COLUMNS and c not in derived))


_FEATURES: dict[tuple, str] = {}


def _feature_store(star: Star, variant: str = "A") -> DataFrame:
    """Feature table with its split, written once per session and version of the folder's tables.

    Training and scoring read the fact many times; the stored table spares its joins and
    needs no recomputation when an executor is lost.
    """
    key = (*_version(star), variant)
    if key not in _FEATURES:
        # B leaves out cancelled shipments before anything is split.
        identified = ml_data.ml_feature_rows(_ml_fact(star, variant), variant)
        split = ml_data.ml_stratified_split(identified, label=ml_data.TARGET[variant])
        path = scratch_path(star.spark, f"features_{variant}")
        ml_data.ml_feature_table(split, variant, keep=["split"]).write.option("compression", "zstd").partitionBy("split").parquet(path)
        _FEATURES[key] = path
    return star.spark.read.parquet(_FEATURES[key])


def _part(star: Star, part: str, variant: str = "A") -> DataFrame:
    return _feature_store(star, variant).filter(F.col("split") == part).drop("split")


_FITTED: dict[tuple, PipelineModel] = {}


def forget(fact: bool = True) -> None:
    """Drop what queries share within a session: fitted models, feature tables and, with ``fact``, the stored fact."""
    for kept in (_FITTED, _FEATURES, _SHARED, _STATES, _STATES_OF):
        kept.clear()
    if fact:
        star_module._FACTS.clear()


def _models(star: Star, names: Sequence[str], variant: str = "A") -> dict[str, PipelineModel]:
    """Models fitted once per session, version of the data and variant; those still missing share their preparation."""
    keys = {name: (*_version(star), variant, name) for name in names}
    missing = [name for name, key in keys.items() if key not in _FITTED]
    if missing:
        found = ml_models.fit_models(_part(star, "train", variant), missing, variant)
        _FITTED.update({keys[name]: model for name, model in found.items()})
    return {name: _FITTED[key] for name, key in keys.items()}


def _model(star: Star, name: str, variant: str = "A") -> PipelineModel:
    return _models(star, [name], variant)[name]


def _predictions(star: Star, name: str, variant: str = "A") -> DataFrame:
    """The held-out rows scored, written once: metrics read them several times, and each task that scores unpacks the whole model."""
    model = _model(star, name, variant)
    return _once(
        star, f"predictions-{model.uid}", lambda: ml_models.predict(model, ml_models.over_cores(_part(star, "test", variant)), name)
    )


@query
def ml_feature_table(star: Star) -> DataFrame:
    return ml_data.ml_feature_table(_ml_fact(star), "A")


@query
def ml_feature_table_alt(star: Star) -> DataFrame:
    return ml_data.ml_feature_table(_ml_fact(star, "B"), "B")


@query
def ml_leakage_guard(star: Star) -> DataFrame:
    numeric = [
        "days_for_shipping_real",
        "days_for_shipment_scheduled",
        "shipping_delay_days",
        "sales",
        "order_item_quantity",
        "order_item_discount_rate",
        "product_price",
        "benefit_per_order",
        "is_late",
    ]
    fact = star.fact(*numeric, "late_delivery_risk")
    return ml_data.ml_leakage_report(fact, numeric, "late_delivery_risk")


@query
def ml_stratified_split(star: Star) -> DataFrame:
    split = ml_data.ml_stratified_split(star.fact(*ml_data.IDENTITY, "late_delivery_risk"))
    return split.groupBy("split", "late_delivery_risk").agg(F.count("*").alias("n"))


@query
def ml_split_rows(star: Star) -> DataFrame:
    """The held-out lines themselves."""
    split = ml_data.ml_stratified_split(star.fact(*ml_data.IDENTITY, "late_delivery_risk"))
    return split.filter(F.col("split") == "test").select("order_id", "line_no", "late_delivery_risk")


@query
def ml_preprocess(star: Star) -> DataFrame:
    """Length and non-zero count of the assembled vectors."""
    from pyspark.ml.functions import vector_to_array

    train = _part(star, "train")
    vectors = ml_models.ml_preprocess("A").fit(train).transform(_part(star, "test"))
    values = vector_to_array("features")
    return vectors.select(
        F.size(values).alias("n_features"),
        F.size(F.filter(values, lambda x: x != 0)).alias("n_nonzero"),
    ).groupBy("n_features", "n_nonzero").agg(F.count("*").alias("n"))


@query
def ml_logistic_regression(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.LOGISTIC_REGRESSION))


@query
def ml_decision_tree(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.DECISION_TREE))


@query
def ml_random_forest(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.RANDOM_FOREST))


@query
def ml_gradient_boosting(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.GRADIENT_BOOSTING))


@query
def ml_logistic_regression_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.LOGISTIC_REGRESSION, "B"))


@query
def ml_decision_tree_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.DECISION_TREE, "B"))


@query
def ml_random_forest_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.RANDOM_FOREST, "B"))


@query
def ml_gradient_boosting_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_predictions(star, ml_models.GRADIENT_BOOSTING, "B"))


def _all_predictions(star: Star, variant: str = "A") -> DataFrame:
    """The held-out rows scored by the four models, which are fitted at once and score at once."""
    _models(star, ml_models.MODELS, variant)
    score = inheritable_thread_target(star.spark)(lambda name: _predictions(star, name, variant))
    with ThreadPool(len(ml_models.MODELS)) as pool:
        return reduce(DataFrame.unionByName, pool.map(score, ml_models.MODELS, chunksize=1))


@query
def ml_best_model(star: Star) -> DataFrame:
    return ml_metrics.ml_best_model(ml_metrics.ml_metrics(_all_predictions(star)))


@query
def ml_best_model_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_best_model(ml_metrics.ml_metrics(_all_predictions(star, "B")))


@query
def ml_confusion_matrix_models(star: Star) -> DataFrame:
    """The four cells of every trained model."""
    return ml_metrics.ml_confusion_matrix(_all_predictions(star))


@query
def ml_confusion_matrix_models_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_confusion_matrix(_all_predictions(star, "B"))


@query
def ml_roc_curve_models(star: Star) -> DataFrame:
    """The curve of every trained model."""
    return ml_metrics.ml_roc_curve(_all_predictions(star))


@query
def ml_roc_curve_models_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_roc_curve(_all_predictions(star, "B"))


@query
def ml_classification_report_models(star: Star) -> DataFrame:
    """Per-class quality of every trained model."""
    return ml_metrics.ml_classification_report(_all_predictions(star))


@query
def ml_classification_report_models_alt(star: Star) -> DataFrame:
    return ml_metrics.ml_classification_report(_all_predictions(star, "B"))


@query
def ml_report_support(star: Star) -> DataFrame:
    """What a report holds whatever the fit: model, class and support, from the decision tree's predictions."""
    report = ml_metrics.ml_classification_report(_predictions(star, ml_models.DECISION_TREE))
    return report.select("model", "class", "support")


@query
def ml_majority_baseline(star: Star) -> DataFrame:
    split = ml_data.ml_stratified_split(star.fact(*ml_data.IDENTITY, "late_delivery_risk"))
    labelled = split.select("split", F.col("late_delivery_risk").alias("label"))
    return ml_metrics.ml_majority_baseline(
        labelled.filter(F.col("split") == "train"), labelled.filter(F.col("split") == "test")
    )


def _fixed(star: Star) -> DataFrame:
    return ml_metrics.ml_fixed_score(
        star.fact("days_for_shipment_scheduled", "order_item_quantity", "late_delivery_risk")
    )


@query
def ml_fixed_score(star: Star) -> DataFrame:
    return _fixed(star)


def ml_metrics_query(star: Star) -> DataFrame:
    return ml_metrics.ml_metrics(_fixed(star))


QUERIES["ml_metrics"] = ml_metrics_query


@query
def ml_confusion_matrix(star: Star) -> DataFrame:
    return ml_metrics.ml_confusion_matrix(_fixed(star))


@query
def ml_roc_curve(star: Star) -> DataFrame:
    return ml_metrics.ml_roc_curve(_fixed(star))


@query
def ml_classification_report(star: Star) -> DataFrame:
    return ml_metrics.ml_classification_report(_fixed(star))


@query
def ml_feature_importance(star: Star) -> DataFrame:
    return ml_models.ml_feature_importance(star.spark, _model(star, ml_models.RANDOM_FOREST))


@query
def ml_feature_importance_alt(star: Star) -> DataFrame:
    return ml_models.ml_feature_importance(star.spark, _model(star, ml_models.RANDOM_FOREST, "B"), "B")


@query
def ml_save_load(star: Star) -> DataFrame:
    """Largest difference between a model's scores before and after storing it, row by row."""
    model = _model(star, ml_models.DECISION_TREE)
    path = scratch_path(star.spark, "model")
    ml_models.save_model(model, path)
    return ml_models.score_difference(model, ml_models.load_model(path), _part(star, "test"))


@query
def ml_batch_score(star: Star) -> DataFrame:
    """Scores of the held-out orders, given in the scoring layout."""
    incoming = _part(star, "test").drop("label")
    return ml_models.ml_batch_score(_model(star, ml_models.DECISION_TREE), incoming)


# --- lookups -----------------------------------------------------------------------------


@query
def product_performance(star: Star) -> DataFrame:
    return lookup.product_performance(
        star.fact("product_name", "sales", "order_item_quantity", "days_for_shipping_real", "late_delivery_risk")
    )


@query
def region_kpis(star: Star) -> DataFrame:
    return lookup.region_kpis(
        star.fact("order_region", "order_id", "sales", "late_delivery_risk", "days_for_shipping_real")
    )


@query
def region_kpis_one(star: Star) -> DataFrame:
    """One region, named in another case."""
    return lookup.region_kpis(
        star.fact("order_region", "order_id", "sales", "late_delivery_risk", "days_for_shipping_real"), "Nation_7"
    )


@query
def forecast_lookup(star: Star) -> DataFrame:
    return _forecasts(star).lookup("brand#7", HORIZON)


@query
def forecast_lookup_periods(star: Star) -> DataFrame:
    """Which months a lookup gives, for a series by another case and for the total in its place."""
    found = [_forecasts(star).lookup(name, HORIZON).withColumn("asked", F.lit(name)) for name in ("brand#7", "nothing")]
    rows = found[0].unionByName(found[1])
    return rows.select("asked", "series_key", "period", "model", F.col("y_hat").isNotNull().alias("has_value"))
