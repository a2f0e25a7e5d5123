"""Every query with a SQL text gives the same rows in Spark and in DuckDB."""

import pytest
from oracle_compare import difference, duck, duck_result, spark_result

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# The export trains all models of the first variant, which the others then share; the second variant's
# take minutes more, and their parts are tested in test_ml.py.
SLOW = {name for name in QUERIES if name.endswith("_alt") and name.startswith("ml_") and name not in SQL}


@pytest.fixture(scope="module")
def duck_connection():
    return duck(SF_DIR)


def test_every_sql_text_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["order_region", "n_line_items", "late_delivery_rate_pct"]
    assert df.count() == 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck_connection, name):
    got = spark_result(QUERIES[name](spark, SF_DIR))
    assert difference(got, duck_result(duck_connection, SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1
