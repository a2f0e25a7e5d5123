from orderlens.schema import RAW_CSV_FIELDS, snake_case
from orderlens.session import scratch_path
from orderlens.sources import files
from orderlens.sources.star import _FACTS, FACT_COLUMNS, Star, orders_fact, stored_fact

SF_DIR = "/root/testdata/sf0.001"


def test_column_names():
    assert snake_case("Days for shipping (real)") == "days_for_shipping_real"
    assert snake_case("Late_delivery_risk") == "late_delivery_risk"
    assert len(RAW_CSV_FIELDS) == 53


def test_pruned_fact_has_the_rows_of_the_full_one(spark):
    full = orders_fact(spark, SF_DIR)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    assert full.count() == lines and set(full.columns) == set(FACT_COLUMNS)
    few = ["order_id", "sales", "market"]
    assert orders_fact(spark, SF_DIR, few).exceptAll(full.select(*few)).count() == 0


def test_pruned_fact_plans_only_needed_joins(spark):
    plan = orders_fact(spark, SF_DIR, ["sales", "order_item_quantity"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan


def test_distinct_fact_equals_distinct_of_fact(spark):
    columns = ["product_card_id", "product_name"]
    pushed = orders_fact(spark, SF_DIR, columns, distinct=True)
    plain = orders_fact(spark, SF_DIR, columns).distinct()
    assert pushed.exceptAll(plain).count() == 0 and plain.exceptAll(pushed).count() == 0


def test_stored_lines_give_the_rows_of_the_joins_and_stay_narrow(spark):
    star, plain = Star(spark, SF_DIR, stored=True), Star(spark, SF_DIR)
    made, wanted = star.fact(), plain.fact()
    assert made.columns == wanted.columns
    assert made.exceptAll(wanted).count() == 0 and wanted.exceptAll(made).count() == 0
    customers = [s.fact("customer_id", "customer_segment", distinct=True) for s in (star, plain)]
    assert sorted(customers[0].collect()) == sorted(customers[1].collect())
    # Columns that follow from others are not stored, nor is anything of part.
    held = set(stored_fact(spark, SF_DIR).columns)
    assert not held & (set(FACT_COLUMNS) | {"p_name", "p_brand", "p_type"})


def test_columns_without_an_order_store_nothing(spark):
    before = dict(_FACTS)
    _FACTS.clear()
    try:
        star = Star(spark, SF_DIR, stored=True)
        assert star.fact("category_name", "sales").count() <= star.raw("sales").count()
        assert not _FACTS
    finally:
        _FACTS.update(before)


def test_csv_round_trip_keeps_blanks_quotes_and_latin1(spark):
    df = spark.createDataFrame([("  a, \"b\" ", "Señor São"), ("x", None)], "t string, u string")
    path = scratch_path(spark, "csv_test")
    files.write_csv(df, path, encoding="ISO-8859-1")
    back = files.read_csv_raw(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_year_filter_prunes_partitions(spark):
    df = spark.createDataFrame([(2015, 1), (2016, 2), (2016, 3)], "order_year int, x int")
    paths = files.write_clean(df, scratch_path(spark, "clean_test"))
    scan = files.read_parquet_clean(spark, paths["parquet"], ["order_year", "x"]).filter("order_year = 2016")
    assert scan.count() == 2
    assert "PartitionFilters: [isnotnull(order_year" in scan._jdf.queryExecution().executedPlan().toString()


def test_write_query_results_counts_rows(spark):
    counts = files.write_query_results(spark, {"a": spark.range(3), "b": spark.range(0)}, scratch_path(spark, "results_test"))
    assert {r["query"]: r["n_rows"] for r in counts.collect()} == {"a": 3, "b": 0}


RAW = "name string, sales double, quantity int"


def _raw(spark, tmp_path, text, **more):
    (tmp_path / "raw.csv").write_text(text, encoding="latin-1")
    schema = spark.createDataFrame([], RAW).schema
    return files.read_csv_raw(spark, str(tmp_path / "raw.csv"), schema, **more)


def test_csv_with_doubled_quotes_separators_and_line_breaks(spark, tmp_path):
    rows = [tuple(r) for r in _raw(spark, tmp_path, 'name,sales,quantity\n"10"" pan, ""deluxe""",299.98,3\n"two\nlines",1.5,2\n').collect()]
    assert rows == [('10" pan, "deluxe"', 299.98, 3), ("two\nlines", 1.5, 2)]


def test_csv_binds_by_name(spark, tmp_path):
    rows = _raw(spark, tmp_path, "extra,quantity,name\nx,3,pan\n")
    assert rows.columns == ["name", "sales", "quantity"] and tuple(rows.first()) == ("pan", None, 3)


def test_malformed_csv_rows_are_counted(spark, tmp_path):
    rows = _raw(spark, tmp_path, "name,sales,quantity\npan,1.5,2\npot,many,2\njar,2.5,x\n", malformed=True)
    assert files.malformed_rows(rows) == 2
    assert rows.filter("_malformed is null").select("name").collect()[0][0] == "pan"


def test_clean_csv_keeps_line_breaks(spark):
    df = spark.createDataFrame([("a\nb", 1), ('say "x"\r\n', 2), ("plain", 3)], "t string, n int")
    path = scratch_path(spark, "clean_lines")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv_clean(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_listing_changes_with_the_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    before = files.listing(spark, str(tmp_path))
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert before and before != files.listing(spark, str(tmp_path))
