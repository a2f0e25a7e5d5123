import datetime
from decimal import Decimal

from orderlens.operators import business, dimensions, eda, inventory, kpi, lookup, supplier


def rows(df):
    return [tuple(r) for r in df.collect()]


def day(text):
    return datetime.datetime.fromisoformat(text)


def sales_frame(spark, months):
    return spark.createDataFrame(
        [(day(d), Decimal(v)) for d, v in months], "order_date timestamp_ntz, sales decimal(18,2)"
    )


def test_growth_with_a_missing_month(spark):
    fact = sales_frame(spark, [("2020-01-05", "100"), ("2020-03-05", "150"), ("2020-04-01", "75")])
    by_row = {r["order_month"]: r["mom_growth_pct"] for r in business.q10_mom_growth(fact).collect()}
    assert by_row == {"2020-01": None, "2020-03": 50.0, "2020-04": -50.0}
    by_calendar = {r["month"]: r["growth"] for r in kpi.bi_mom_growth_calendar(fact).collect()}
    assert by_calendar == {"2020-01": None, "2020-02": None, "2020-03": None, "2020-04": -0.5}


def test_running_total_ends_at_total(spark):
    fact = sales_frame(spark, [("2020-01-05", "100.10"), ("2020-02-05", "50.20"), ("2020-02-06", "1.00")])
    last = max(business.q12_cumulative_revenue(fact).collect(), key=lambda r: r["order_month"])
    assert last["cumulative_sales"] == 151.30 and last["next_month_sales"] is None


def test_growth_drops_tail_months(spark):
    fact = sales_frame(spark, [(f"2020-0{m}-01", str(100 + m)) for m in range(1, 7)])
    row = kpi.kpi_sales_growth(fact, 4).collect()[0]
    assert (row["first_month"], row["last_month"]) == ("2020-01", "2020-02")


def test_dimension_versions_fan_out_and_are_reported(spark):
    fact = spark.createDataFrame([(1, Decimal("10.00")), (1, Decimal("5.00"))], "product_card_id int, sales decimal(18,2)")
    dim = spark.createDataFrame([(1, "cat", "old"), (1, "cat", "new")], "product_card_id int, category_name string, product_name string")
    top = business.q02_top_products(fact, dim)
    assert sorted(rows(top)) == [("cat", "new", 15.0, 1), ("cat", "old", 15.0, 1)]
    assert rows(dimensions.dim_key_check(dim, "product_card_id")) == [(1, 2)]


def test_top_per_category_breaks_ties_by_name(spark):
    fact = spark.createDataFrame([(i, Decimal("10.00")) for i in range(5)], "product_card_id int, sales decimal(18,2)")
    dim = spark.createDataFrame([(i, "c", f"p{i}") for i in range(5)], "product_card_id int, category_name string, product_name string")
    assert sorted((r["rn"], r["product_name"]) for r in business.q11_top3_per_category(fact, dim).collect()) == [
        (1, "p0"),
        (2, "p1"),
        (3, "p2"),
    ]


def test_order_grain_and_line_grain_cancellation(spark):
    fact = spark.createDataFrame(
        [(1, "CANCELED"), (1, "CANCELED"), (1, "CANCELED"), (2, "COMPLETE")], "order_id int, order_status string"
    )
    assert dict(rows(kpi.kpi_cancellation_rate(fact))) == {"line_items": 75.0, "orders": 50.0}


def test_risk_bands_at_the_cut_points(spark):
    fact = spark.createDataFrame(
        [(d, Decimal("1.00"), 1, late) for d, n in (("a", 45), ("b", 55), ("c", 56)) for late in [1] * n + [0] * (100 - n)],
        "department_name string, sales decimal(18,2), days_for_shipping_real int, is_late int",
    )
    bands = {r["department_name"]: r["risk_category"] for r in supplier.supplier_scorecard_ranked(fact).collect()}
    assert bands == {"a": "Lower Risk", "b": "Moderate Risk", "c": "Higher Risk"}


def demand_frame(spark, cells):
    return spark.createDataFrame(
        [(p, day(f"{m}-03"), q, 1, Decimal("1.00")) for p, m, q in cells],
        "product_name string, order_date timestamp_ntz, order_item_quantity bigint, order_id int, sales decimal(18,2)",
    )


def test_demand_profile_zero_fill(spark):
    fact = demand_frame(spark, [("x", "2020-01", 4), ("x", "2020-02", 2), ("y", "2020-01", 3), ("z", "2020-03", 9)])
    filled = {r["product_name"]: r for r in inventory.demand_profile(fact, last_complete_month="2020-02").collect()}
    assert set(filled) == {"x", "y"}
    assert filled["x"]["avg_units_per_month"] == 3.0 and filled["x"]["demand_coefficient_of_variation"] == 0.471
    assert filled["y"]["avg_units_per_month"] == 1.5 and filled["y"]["demand_coefficient_of_variation"] == 1.414
    active = {r["product_name"] for r in inventory.demand_profile(fact, last_complete_month="2020-02", zero_fill=False).collect()}
    assert active == {"x"}


def test_single_month_product_has_zero_variability(spark):
    fact = demand_frame(spark, [("x", "2020-01", 4), ("y", "2020-01", 3), ("y", "2020-02", 5)])
    found = {r["product_name"]: r["demand_cv"] for r in inventory.product_demand_cv(fact).collect()}
    assert found == {"x": 0.0, "y": 0.35}


def test_bands_are_right_closed_and_lower_wins_on_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "avg_units_per_month int")
    classes = [r["mover_class"] for r in inventory.mover_class(df, (1 / 3, 2 / 3)).orderBy("avg_units_per_month").collect()]
    assert classes == ["Slow Mover", "Slow Mover", "Medium Mover", "Fast Mover"]
    same = spark.createDataFrame([(7,)] * 3, "avg_units_per_month int")
    assert {r["mover_class"] for r in inventory.mover_class(same).collect()} == {"Slow Mover"}


def test_class_sizes_of_a_hundred_products(spark):
    df = spark.createDataFrame([(i * 1.5,) for i in range(100)], "avg_units_per_month double")
    counts = dict(rows(inventory.mover_class(df).groupBy("mover_class").count()))
    assert counts == {"Slow Mover": 33, "Medium Mover": 33, "Fast Mover": 34}


def test_histogram_has_empty_bins_and_closed_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 10.0, None)], "x double")
    assert [(r["bin"], r["n"]) for r in eda.histogram(df, "x", 4).orderBy("bin").collect()] == [(0, 2), (1, 0), (2, 0), (3, 1)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert sum(r["n"] for r in eda.histogram(same, "x", 2).collect()) == 2


def test_boxplot_whiskers(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 5, 50)] + [("b", 7)], "k string, x int")
    found = {r["k"]: r for r in eda.boxplot(df, "x", "k").collect()}
    assert (found["a"]["q1"], found["a"]["median"], found["a"]["q3"]) == (2.25, 3.5, 4.75)
    assert (found["a"]["whisker_hi"], found["a"]["n_outliers"], found["a"]["max"]) == (5.0, 1, 50.0)
    assert found["b"]["n_outliers"] == 0 and found["b"]["median"] == 7.0
    alone = eda.boxplot(df.filter("k = 'a'"), "x").collect()[0]
    assert alone["median"] == 3.5 and alone["n_outliers"] == 1


def test_scatter_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).selectExpr(
        "id", "id * 0.001D AS order_item_discount_rate", "id * 0.5D AS order_item_profit_ratio", "CAST(id % 2 AS int) AS late_delivery_risk"
    )
    first = sorted(rows(eda.eda_scatter_sample(df.repartition(7), ["id"], 50)))
    assert first == sorted(rows(eda.eda_scatter_sample(df.repartition(2), ["id"], 50))) and len(first) == 50


def test_lookup_ignores_case_and_absent_is_empty(spark):
    fact = spark.createDataFrame(
        [("Fan Shop", 1, Decimal("2.50"), 1, 3)],
        "order_region string, order_id int, sales decimal(18,2), late_delivery_risk int, days_for_shipping_real int",
    )
    assert rows(lookup.region_kpis(fact, "fan SHOP")) == [("fan shop", 2.5, 1, 100.0, 3.0)]
    assert rows(lookup.region_kpis(fact, "nowhere")) == []


def test_date_dimension_is_gapless(spark):
    fact = spark.createDataFrame([(day("2020-02-28"),), (day("2020-03-02"),)], "order_date timestamp_ntz")
    assert [r["date"].isoformat() for r in dimensions.dim_date(fact).collect()] == [
        "2020-02-28",
        "2020-02-29",
        "2020-03-01",
        "2020-03-02",
    ]
