import datetime

import numpy as np

from orderlens.operators import timeseries as ts
from orderlens.operators.holt_winters import FALLBACK, HOLT_WINTERS, TOO_SHORT, fit_forecast, forecast_series, season_by_length


def month(i):
    return datetime.date(2015 + i // 12, i % 12 + 1, 1)


def series(spark, **values):
    return spark.createDataFrame(
        [(key, month(i), float(v)) for key, vs in values.items() for i, v in enumerate(vs)],
        "series_key string, period date, y double",
    )


def seasonal(n):
    t = np.arange(n)
    return 100 + 2 * t + 20 * np.sin(2 * np.pi * t / 12)


def test_noiseless_seasonal_series_is_reproduced():
    y = seasonal(48)
    np.testing.assert_allclose(fit_forecast(y[:36], 12, 12), y[36:], atol=1e-4)


def test_constant_and_zero_series():
    np.testing.assert_allclose(fit_forecast(np.full(30, 7.0), 12, 6), np.full(6, 7.0), atol=1e-6)
    np.testing.assert_allclose(fit_forecast(np.zeros(30), 12, 6), np.zeros(6), atol=1e-9)


def test_beats_naive_on_noisy_seasonal_data(spark):
    rng = np.random.default_rng(3)
    split = ts.ts_time_split(series(spark, s=seasonal(60) + rng.normal(0, 2, 60)), 6)
    accuracy = ts.ts_accuracy(ts.ts_naive_forecast(split).unionByName(ts.ts_holt_winters(split, 6)))
    best = ts.ts_best_model(accuracy).collect()[0]
    assert best["best_model"] == HOLT_WINTERS and best["improvement_over_baseline_pct"] > 50


def test_short_series_falls_back_and_order_of_rows_does_not_matter(spark):
    df = series(spark, short=[1, 2, 3, 4, 5, 6], long=list(seasonal(30)))
    mean = {"short_series": "moving_average"}
    models = {r["series_key"]: r["model"] for r in forecast_series(df, 2, **mean).collect()}
    assert models == {"short": FALLBACK, "long": HOLT_WINTERS}
    short = [r["y_hat"] for r in forecast_series(df.orderBy(df.period.desc()), 2, **mean).filter("series_key = 'short'").collect()]
    assert short == [4.5, 4.5]
    plain = {(r["series_key"], r["model"], r["y_hat"] is None) for r in forecast_series(df, 2).collect()}
    assert plain == {("short", TOO_SHORT, True), ("long", HOLT_WINTERS, False)}


def test_season_is_the_same_for_every_series_unless_asked(spark):
    df = series(spark, a=list(seasonal(30)), b=list(seasonal(120)))
    models = lambda **more: {r["series_key"]: r["model"] for r in forecast_series(df, 1, "week", **more).collect()}
    assert models() == {"a": TOO_SHORT, "b": HOLT_WINTERS}
    assert models(season=season_by_length) == {"a": HOLT_WINTERS, "b": HOLT_WINTERS}
    assert models(season=12) == {"a": HOLT_WINTERS, "b": HOLT_WINTERS}


def test_forward_periods_follow_the_last(spark):
    forward = ts.ts_refit_forward(series(spark, s=list(seasonal(30))), 3).orderBy("period").collect()
    assert [r["period"] for r in forward] == [month(30), month(31), month(32)]


def test_weekly_demand_fills_weeks_and_drops_the_last(spark):
    rows = [("2017-09-25", 3), ("2017-10-01", 4), ("2017-10-16", 5), ("2017-10-30", 9)]
    fact = spark.createDataFrame(
        [(datetime.datetime.fromisoformat(d), q) for d, q in rows], "order_date timestamp_ntz, order_item_quantity bigint"
    )
    got = [(r["period"].isoformat(), r["y"]) for r in ts.ts_weekly_demand(fact).orderBy("period").collect()]
    assert got == [("2017-10-01", 7.0), ("2017-10-08", 0.0), ("2017-10-15", 0.0), ("2017-10-22", 5.0), ("2017-10-29", 0.0)]


def test_every_excluded_period_is_reported(spark):
    df = series(spark, s=range(6))
    assert ts.ts_exclude_tail(df, "2015-04-30").count() == 4
    row = ts.ts_excluded_periods(df, "2015-04-30").collect()[0]
    assert (row["n_excluded"], row["first_excluded"], row["last_excluded"]) == (2, month(4), month(5))


def test_planning_signal_bands(spark):
    train = series(spark, up=[100] * 4, flat=[100] * 4, down=[100] * 4, none=[0] * 4)
    ahead = series(spark, up=[106] * 4, flat=[105] * 4, down=[94] * 4, none=[1] * 4).withColumnRenamed("y", "y_hat")
    signals = {r["series_key"]: r["signal"] for r in ts.ts_planning_signal(train, ahead).collect()}
    assert signals == {"up": "increase", "flat": "hold", "down": "taper", "none": None}


def test_flat_tail_is_detected(spark):
    flags = [r["is_flat"] for r in ts.ts_flatline_check(series(spark, s=[1, 9, 4, 7] + [480] * 9)).orderBy("period").collect()]
    assert flags == [False] * 11 + [True] * 2


def test_lookup_falls_back_to_the_total(spark):
    forward = series(spark, all=[1, 2], Fishing=[3, 4]).withColumnRenamed("y", "y_hat")
    assert {r["y_hat"] for r in ts.forecast_lookup(forward, "FISHING").collect()} == {3.0, 4.0}
    assert {r["y_hat"] for r in ts.forecast_lookup(forward, "unknown").collect()} == {1.0, 2.0}
