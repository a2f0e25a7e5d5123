"""The product-month table: sums that merge, exact distinct orders, and one scan of the fact."""

import datetime
import random

import pytest

from orderlens.operators import inventory
from orderlens.plans import registry
from orderlens.sources.star import Star

SCHEMA = "product_name string, order_id bigint, order_date timestamp_ntz, order_item_quantity bigint, sales decimal(18,2)"


def lines(seed=1, n=600):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        day = None if rng.random() < 0.05 else datetime.datetime(2017, rng.randint(1, 5), rng.randint(1, 28))
        order = None if rng.random() < 0.05 else rng.randint(1, 60)
        product = None if rng.random() < 0.05 else f"p{int(12 * rng.random() ** 3)}"
        out.append((product, order, day, rng.randint(1, 9), rng.randint(100, 9999) / 100))
    return [(p, o, d, q, __import__("decimal").Decimal(str(s))) for p, o, d, q, s in out]


def test_orders_add_up_to_distinct_orders_although_they_span_months(spark):
    data = lines()
    months = inventory.product_months(spark.createDataFrame(data, SCHEMA))
    got = {r["product_name"]: r["n"] for r in months.groupBy("product_name").agg({"orders": "sum"}).toDF("product_name", "n").collect()}
    expected = {}
    for p, o, *_ in data:
        if p is not None:
            expected.setdefault(p, set())
            if o is not None:
                expected[p].add(o)
    assert got == {p: len(orders) for p, orders in expected.items()}


def test_cells_equal_a_plain_count(spark):
    data = lines(2)
    expected = {}
    for p, _, d, q, s in data:
        if p is not None:
            cell = expected.setdefault((p, d and f"{d:%Y-%m}"), [0, 0, 0])
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + q, cell[2] + s
    rows = inventory.product_months(spark.createDataFrame(data, SCHEMA)).collect()
    assert {(r["product_name"], r["ym"]): [r["lines"], r["units"], r["sales"]] for r in rows} == expected


def test_products_equal_those_of_the_lines(spark):
    data = lines(3)
    rows = inventory.product_demand_cv(spark.createDataFrame(data, SCHEMA)).collect()
    for r in rows:
        mine = [x for x in data if x[0] == r["product_name"]]
        assert r["total_qty_sold"] == sum(x[3] for x in mine)
        assert r["n_orders"] == len({x[1] for x in mine} - {None})
        cells = {}
        for _, _, d, q, _ in mine:
            if d:
                cells[d.month] = cells.get(d.month, 0) + q
        values = list(cells.values())
        mean = sum(values) / len(values) if values else 0
        spread = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else 0
        assert r["demand_cv"] == pytest.approx(spread / mean if mean else 0, abs=0.0051)


@pytest.mark.parametrize("name", ["inventory_profile", "stockout_risk_flag", "mover_class", "mover_class_qty", "inventory_summary"])
def test_plans_read_no_fact_and_few_small_tables(spark, name):
    star = Star(spark, "/root/testdata/sf0.001", stored=True)
    found = registry.QUERIES[name](star)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 8
    assert "l_orderkey" not in plan and "order_item_quantity" not in plan
