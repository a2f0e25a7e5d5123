"""Two-stage duplicate removal: whole rows move only where a fingerprint repeats."""

import math

import pytest
from pyspark.sql import functions as F

from orderlens.operators import cleaning, quality
from orderlens.operators.duplicates import count_repeated, distinct_rows, split_repeated
from orderlens.sources.files import stored


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffled(spark, work):
    """Bytes of shuffle that the executors write during some work."""

    def total():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    work()
    return total() - before


def test_a_fingerprint_clash_keeps_both_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "a"), (3, None), (3, None)], "x int, y string")
    same = F.lit(7).cast("long")
    assert rows(distinct_rows(df, same)) == rows(df.distinct())
    assert count_repeated(df, same).collect()[0]["n"] == 2


def test_nulls_that_share_a_hash_are_told_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert rows(distinct_rows(df)) == [("a", None), (None, "a")]


@pytest.mark.parametrize("most", [0, 2, 1000])
def test_same_as_distinct_on_either_way(spark, most):
    df = spark.range(4000).selectExpr("id % 1500 AS a", "IF(id % 3 = 0, NULL, id % 2) AS b", "CAST(id % 1500 AS string) AS c").repartition(5)
    assert rows(distinct_rows(df, most=most)) == rows(df.distinct())
    assert count_repeated(df, most=most).collect()[0]["n"] == 4000 - df.distinct().count()


def test_nan_and_negative_zero_are_equal_to_their_like(spark):
    df = spark.createDataFrame([(math.nan,), (math.nan,), (0.0,), (-0.0,)], "x double")
    assert distinct_rows(df).count() == 2 and count_repeated(df).collect()[0]["n"] == 2


def test_no_repeats_no_rows_and_one_hot_row(spark):
    df = spark.range(50).withColumn("s", F.lit("x"))
    single, among = split_repeated(df)
    assert among is None and single.count() == 50
    assert distinct_rows(df.limit(0)).count() == 0 and count_repeated(df).collect()[0]["n"] == 0
    hot = df.select(F.lit(1).alias("a"), F.lit("x").alias("s"))
    assert rows(distinct_rows(hot)) == [(1, "x")] and count_repeated(hot).collect()[0]["n"] == 49


def test_only_fingerprints_are_shuffled(spark):
    text = F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(i)).cast("string"), 256) for i in range(8)])
    df = stored(spark.range(20_000).select("id", text.alias("text")).unionByName(spark.range(40).select("id", text.alias("text"))), "wide")
    whole = shuffled(spark, lambda: df.distinct().write.format("noop").mode("overwrite").save())
    staged = shuffled(spark, lambda: distinct_rows(df).write.format("noop").mode("overwrite").save())
    assert whole > 20_000 * 256 and staged < 20_000 * 24 and distinct_rows(df).count() == 20_000


def test_cleaning_step_and_check_use_it(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "x int, y string")
    assert rows(cleaning.dedupe(df, lambda d: stored(d, "t"))) == [(1, "a"), (2, "a")]
    assert quality.dq_duplicate_rows(df).collect()[0]["value"] == 1


def test_rows_told_apart_by_few_columns_are_still_compared_as_a_whole(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", "x"), (2, "a", "y"), (None, "a", "y"), (None, "a", "y")], "k int, t string, u string")
    found = quality.dq_duplicate_rows(rows, ["k"]).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in quality.dq_duplicate_rows(rows).collect()]
    assert found[0]["value"] == 2.0
