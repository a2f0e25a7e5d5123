import datetime

import pytest

from orderlens.operators import cleaning, quality


def rows(df):
    return [tuple(r) for r in df.collect()]


def as_dict(df):
    return {r["column_name"]: r["value"] for r in df.collect()}


def test_trim_keeps_inner_blanks_and_nulls(spark):
    df = spark.createDataFrame([("  South of  USA ",), (None,), ("\tx\n",)], "order_region string")
    assert rows(cleaning.trim_text(df)) == [("South of  USA",), (None,), ("x",)]


def test_parse_dates_two_layouts_and_bad_text(spark):
    df = spark.createDataFrame(
        [("1/31/2018 22:56", "2018-02-03 22:56:00"), ("never", None), ("", "13/45/2018 1:00")],
        "order_date string, shipping_date string",
    )
    parsed = cleaning.parse_dates(df)
    moment = datetime.datetime(2018, 1, 31, 22, 56)
    assert rows(parsed) == [(moment, datetime.datetime(2018, 2, 3, 22, 56)), (None, None), (None, None)]
    assert as_dict(quality.dq_unparseable_dates(parsed)) == {"order_date": 2, "shipping_date": 2, "total": 4}


def test_parse_dates_leaves_timestamps_alone(spark):
    df = spark.createDataFrame([(datetime.datetime(2018, 1, 1),)], "order_date timestamp_ntz")
    assert rows(cleaning.parse_dates(df)) == [(datetime.datetime(2018, 1, 1),)]


def test_fill_nulls_variants_and_absent_column(spark):
    df = spark.createDataFrame([(None,), (725.0,)], "customer_zipcode double")
    assert rows(cleaning.fill_nulls(df)) == [(-1,), (725,)]
    assert rows(cleaning.fill_nulls(df, value=0)) == [(0,), (725,)]
    other = spark.createDataFrame([(1,)], "x int")
    assert cleaning.fill_nulls(other).columns == ["x"]


def test_drop_columns_ignores_absent_ones(spark):
    df = spark.createDataFrame([(1, "a")], "order_id int, customer_email string")
    assert cleaning.drop_columns(df).columns == ["order_id"]


def test_clip_days_keeps_null(spark):
    df = spark.createDataFrame([(-3,), (None,), (2,)], "days_for_shipping_real int")
    assert rows(cleaning.clip_days(df)) == [(0,), (None,), (2,)]


def test_dedupe_and_count_of_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, None)], "a int, b string")
    assert as_dict(quality.dq_duplicate_rows(df)) == {"all_columns": 2}
    assert sorted(rows(cleaning.dedupe(df)), key=str) == [(1, "a"), (1, None)]


def test_filter_valid_and_invalid_counts(spark):
    df = spark.createDataFrame(
        [(1.0, 1, 1.0, 1), (-1.0, 1, -1.0, -1), (1.0, 0, 1.0, 1), (None, 2, None, None), (1.0, -2, 1.0, 0)],
        "sales double, order_item_quantity int, product_price double, days_for_shipping_real int",
    )
    assert cleaning.filter_valid(df).count() == 1
    loose = as_dict(quality.dq_invalid_numeric(df))
    assert loose == {"sales": 1, "order_item_quantity": 1, "product_price": 1, "days_for_shipping_real": 1}
    assert as_dict(quality.dq_invalid_numeric(df, True))["order_item_quantity"] == 2


def test_missing_values_only_where_any(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 1)], "a int, b string, c int")
    assert [(r["column_name"], r["value"]) for r in quality.dq_missing_values(df).collect()] == [("b", 2), ("c", 1)]


def test_grain_and_key_assertion(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "order_id int, line_no int")
    found = as_dict(quality.dq_grain_check(df))
    assert found["n_rows"] == 3 and found["n_unique_orders"] == 2 and found["n_unique_line_keys"] == 3
    assert found["overstatement_pct"] == 50.0 and found["avg_items_per_order"] == 1.5
    assert quality.assert_unique_key(df, ["order_id", "line_no"]) is df
    with pytest.raises(ValueError):
        quality.assert_unique_key(df, ["order_id"])


def test_iqr_flags(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in values], "sales double")
    flagged = cleaning.flag_iqr_outliers(df, ["sales"])
    assert {r["sales"]: r["outlier_sales"] for r in flagged.collect()} == {
        v: v == 100.0 for v in values
    }


def test_iqr_flags_on_constant_and_empty_input(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "sales double")
    assert [r["outlier_sales"] for r in cleaning.flag_iqr_outliers(df, ["sales"]).collect()] == [False] * 3
    assert cleaning.flag_iqr_outliers(df.limit(0), ["sales"]).count() == 0


def test_order_level_view_is_first_line(spark):
    df = spark.createDataFrame(
        [(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "order_id int, line_no int, status string"
    )
    assert sorted(rows(cleaning.order_level_view(df, ["line_no"]))) == [(1, 1, "a"), (2, 5, "c")]


def test_calendar_columns(spark):
    df = spark.createDataFrame(
        [(datetime.datetime(2017, 10, 1, 12),), (datetime.datetime(2017, 10, 2),), (None,)], "order_date timestamp_ntz"
    )
    sunday, monday, missing = cleaning.derive_calendar(df).collect()
    assert sunday["order_week"] == "2017-09-25/2017-10-01" and sunday["order_dow"] == "Sunday"
    assert monday["order_week"] == "2017-10-02/2017-10-08" and monday["order_year_month"] == "2017-10"
    assert missing["order_year"] is None and missing["order_year_month"] is None
    assert [r["order_dow_num"] for r in cleaning.derive_dow_monthnum(df).collect()] == [6, 0, None]


def test_late_and_cancelled_flags(spark):
    df = spark.createDataFrame(
        [("Late delivery", "CANCELED"), ("Shipping on time", "SUSPECTED_FRAUD"), (None, "COMPLETE")],
        "delivery_status string, order_status string",
    )
    assert [r["is_late"] for r in cleaning.derive_is_late(df).collect()] == [1, 0, 0]
    assert [r["is_cancelled_or_fraud"] for r in cleaning.flag_cancelled(df).collect()] == [True, True, False]


def test_dates_do_not_depend_on_the_session_time_zone(spark):
    from pyspark.sql import functions

    kept = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("3/8/2015 2:30", None), ("11/1/2015 1:30", "x")], "order_date string, shipping_date string")
    found = set()
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = cleaning.parse_dates(df, ["order_date", "shipping_date"]).select(
                functions.col("order_date").cast("string"), "shipping_date"
            )
            found.add(tuple(map(tuple, rows.collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert found == {(("2015-03-08 02:30:00", None), ("2015-11-01 01:30:00", None))}


@pytest.mark.parametrize("variant", ["A", "B"])
def test_the_log_removes_repeats_once(spark, monkeypatch, variant):
    from orderlens.plans import registry
    from orderlens.sources.star import Star

    removed, plain = [], cleaning.distinct_rows
    monkeypatch.setattr(cleaning, "distinct_rows", lambda *args: removed.append(args) or plain(*args))
    raw = Star(spark, "/root/testdata/sf0.001").raw()
    found = rows(cleaning.quality_log(raw, variant))
    assert len(removed) == 1
    slim = cleaning.fill_nulls(cleaning.drop_columns(raw), value=-1 if variant == "A" else 0)
    assert ("duplicate_rows", "all_columns", float(slim.count() - slim.distinct().count())) in found
    told = cleaning.unique_rows(raw, variant, told_by=registry._KEPT_IDENTITY)
    assert told.count() == slim.distinct().count() and told.exceptAll(slim.distinct()).count() == 0


def test_removed_rows_of_no_rows(spark):
    none = spark.createDataFrame([], "a int")
    assert rows(quality.dq_removed_rows(none, none)) == [("duplicate_rows", "all_columns", 0.0)]
