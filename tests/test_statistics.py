import math
import random

import numpy as np
import pytest

from orderlens.functions import tails
from orderlens.functions.ordered import (
    column_quantiles,
    interval,
    quantiles_of_counts,
    running_sums,
    value_counts,
)
from orderlens.operators import statistics


def test_tail_functions_match_published_tables():
    assert tails.f_tail(4.26, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tails.t_quantile(0.025, 10) == pytest.approx(-2.228138852, abs=1e-8)
    assert tails.beta_cdf(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-12)
    assert tails.f_tail(1e6, 3, 1000) == pytest.approx(0.0, abs=1e-12)


def test_interval_never_decreases(spark):
    values = sorted([0.0, -0.0, 1e-9, -1e-9, 1e12, -1e12] + [random.Random(1).gauss(0, 1000) for _ in range(500)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    numbers = [r["b"] for r in df.select("i", interval(df.v).alias("b")).orderBy("i").collect()]
    assert numbers == sorted(numbers)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    # One value holds a third of the rows, and the spread covers many magnitudes.
    values = [42.5] * 400 + [round(rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 7), 3) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    wanted = (0.0, 0.25, 0.33, 0.5, 0.66, 0.999, 1.0)
    row = column_quantiles(df, ["v"], wanted).collect()[0]
    assert row["n"] == len(values)
    np.testing.assert_allclose(row["quantiles"], np.quantile(values, wanted), rtol=1e-12, atol=1e-12)


def test_grouped_quantiles_match_brute_force(spark):
    rng = random.Random(5)
    data = {k: [round(rng.expovariate(0.01), 2) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 501))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r["k"]: r["quantiles"] for r in quantiles_of_counts(value_counts(df, "v", ["k"]), "v", (0.1, 0.5), ["k"]).collect()}
    for key, values in data.items():
        np.testing.assert_allclose(got[key], np.quantile(values, (0.1, 0.5)), rtol=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_match_brute_force(spark, descending):
    rng = random.Random(9)
    data = [(k, v, rng.randint(0, 5)) for k in "ab" for v in sorted({round(rng.gauss(0, 50), 1) for _ in range(200)})]
    df = spark.createDataFrame(data, "k string, v double, n int")
    for r in running_sums(df, "v", ["n"], ["k"], descending).collect():
        same = [(v, n) for k, v, n in data if k == r["k"]]
        assert r["n_before"] == sum(n for v, n in same if (v > r["v"] if descending else v < r["v"]))
        assert r["n_total"] == sum(n for _, n in same)


def test_describe(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, None)], "x double")
    row = statistics.stats_describe(df, ["x"]).collect()[0]
    assert (row["count"], row["mean"], row["std"], row["p25"], row["p50"], row["max"]) == (3, 2.33, 1.53, 1.5, 2.0, 4.0)


def test_correlation_with_nulls_and_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 9.0, 5.0)], "a double, b double, c double")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in statistics.stats_correlation(df, ["a", "b", "c"]).collect()}
    assert len(r) == 9 and r["a", "a"] == 1.0 and r["c", "c"] is None and r["a", "c"] is None
    assert r["a", "b"] == r["b", "a"] == round(np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1], 3)


def test_anova_textbook(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, x int")
    row = statistics.stats_anova(df, "x", "g").collect()[0]
    assert (row["k"], row["n"]) == (3, 18)
    assert row["f_statistic"] == pytest.approx(9.2647, abs=1e-4) and row["p_value"] == pytest.approx(0.002399, abs=2e-6)
    assert row["reject_h0"] is True


def cross(spark, table):
    data = [(a, b) for (a, b), n in table.items() for _ in range(n)]
    return spark.createDataFrame(data, "a string, b int")


def test_chi_square_yates_only_for_two_by_two(spark):
    df = cross(spark, {("x", 0): 10, ("x", 1): 20, ("y", 0): 30, ("y", 1): 15})
    plain = statistics.stats_chi_square(df, "a", "b", yates=False).collect()[0]
    fixed = statistics.stats_chi_square(df, "a", "b").collect()[0]
    n, ad_bc = 75, abs(10 * 15 - 20 * 30)
    product = 30 * 45 * 40 * 35
    assert plain["chi2_statistic"] == pytest.approx(n * ad_bc**2 / product, abs=1e-4)
    assert fixed["chi2_statistic"] == pytest.approx(n * (ad_bc - n / 2) ** 2 / product, abs=1e-4)
    assert fixed["p_value"] == pytest.approx(math.erfc(math.sqrt(n * (ad_bc - n / 2) ** 2 / product / 2)), abs=1e-6)


def test_chi_square_counts_empty_cells(spark):
    df = cross(spark, {("x", 0): 10, ("y", 1): 20, ("z", 0): 5, ("z", 1): 5})
    observed = np.array([[10, 0], [0, 20], [5, 5]], dtype=float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    row = statistics.stats_chi_square(df, "a", "b").collect()[0]
    assert row["dof"] == 2 and row["chi2_statistic"] == round(((observed - expected) ** 2 / expected).sum(), 4)


def test_chi_square_diagonal_two_by_two(spark):
    row = statistics.stats_chi_square(cross(spark, {("x", 0): 8, ("y", 1): 8}), "a", "b").collect()[0]
    assert row["chi2_statistic"] == pytest.approx(4 * 3.5**2 / 4, abs=1e-4)


def test_mean_interval(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, None)], "x int")
    row = statistics.stats_mean_ci(df, "x").collect()[0]
    half = 2.776445 * math.sqrt(2.5) / math.sqrt(5)
    assert row["n"] == 5 and row["ci_lower"] == pytest.approx(3 - half, abs=1e-4)
    assert row["ci_upper"] == pytest.approx(3 + half, abs=1e-4)


def test_tails_meet_their_limits_with_many_degrees_of_freedom():
    from orderlens.functions import tails

    for dof in (1e6, 5e6, 2e7, 6e9, 6e11, 1e13):
        assert abs(tails.t_quantile(0.975, dof) - 1.959963985) < 3e-6
        assert abs(tails.f_tail(1.0, 3, dof) - 0.391625176) < 1e-6
        assert abs(tails.f_tail(4.0, 1, dof) - 2 * tails.t_tail(2.0, dof)) < 1e-8
    for dof in (0.99e7, 1.01e7):
        assert abs(tails.t_tail(2.5, dof) - 0.006209665) < 1e-8


def test_variability_of_very_large_totals(spark):
    from pyspark.sql import functions as F

    from orderlens.functions.columns import cv_from_sums

    units = [2 * 10**13, 10**13]
    row = spark.createDataFrame([(2, str(sum(units)), str(sum(u * u for u in units)))], "n long, t string, s string")
    value = row.select(cv_from_sums(F.col("n"), F.col("t"), F.col("s"))).first()[0]
    assert abs(value - (0.5**0.5 * 10**13) / (1.5 * 10**13)) < 1e-12


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_running_sums_and_quantiles_at_any_scale(spark, scale):
    from orderlens.functions.ordered import column_quantiles, running_sums

    pick = random.Random(4)
    values = {pick.uniform(-1, 1) * scale for _ in range(300)} | {(0.7 + k * 1e-9) * scale for k in range(300)} | {0.0, scale, -scale}
    rows = [(v, pick.randrange(1, 5)) for v in values]
    frame = spark.createDataFrame(rows, "v double, n long")
    got = {r.v: r.n_before for r in running_sums(frame, "v", ["n"]).collect()}
    total = 0
    for v, n in sorted(rows):
        assert got[v] == total
        total += n
    found = column_quantiles(frame, ["v"], [0.1, 0.5, 0.9]).first().quantiles
    np.testing.assert_allclose(found, np.quantile([v for v, _ in rows], [0.1, 0.5, 0.9]), rtol=1e-12)


def test_intervals_are_narrow_everywhere(spark):
    from pyspark.sql import functions as F

    from orderlens.functions.ordered import interval

    for scale in (1e-300, 1e-9, 1.0, 1e12):
        values = [scale * (1 + k / 5000) for k in range(5001)]
        rows = spark.createDataFrame([(v,) for v in [-v for v in reversed(values)] + [0.0] + values], "v double")
        places = [r[0] for r in rows.select(interval(F.col("v"))).collect()]
        assert places == sorted(places) and len(set(places)) > 9000


def test_column_quantiles_of_counted_rows(spark):
    from orderlens.functions.ordered import column_quantiles

    counted = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3), (4.0, 2)], "v double, n long")
    rows = counted.selectExpr("explode(array_repeat(v, CAST(n AS int))) AS v")
    wanted = [0.1, 0.5, 0.75, 0.9]
    expected = column_quantiles(rows, ["v"], wanted).collect()
    assert column_quantiles(counted, ["v"], wanted, counted["n"]).collect() == expected
