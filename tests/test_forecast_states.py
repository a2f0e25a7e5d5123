"""Batched fits, three-model selection, forward refit, and the store of fitted states."""

import datetime

import numpy as np
import pytest

from orderlens.operators import timeseries as ts
from orderlens.operators.forecast_store import ForecastStore
from orderlens.operators.holt_winters import (
    HOLT_WINTERS,
    MOVING_AVERAGE,
    NAIVE,
    TOO_SHORT,
    fit_forecast,
    fit_states,
    forecast_series,
    forecast_states,
    holt_winters_states,
    series_arrays,
)


def month(i):
    return datetime.date(2015 + i // 12, i % 12 + 1, 1)


def series(spark, values):
    rows = [(key, month(i), float(v)) for key, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_key string, period date, y double")


def noisy(n, seed, m=12):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + rng.normal(0, 30) + rng.normal() * t + 20 * rng.random() * np.sin(2 * np.pi * t / m) + rng.normal(0, 6, n)


def carried(found, b, n, horizon):
    level, trend, season, _ = found
    steps = np.arange(1, horizon + 1)
    return level[b] + steps * trend[b] + season[b][(n + steps - 1) % season.shape[1]]


@pytest.mark.parametrize(("n", "m"), [(24, 12), (41, 12), (75, 12), (31, 13), (120, 52)])
def test_many_series_together_equal_each_alone(n, m):
    values = np.array([noisy(n, s, m) for s in range(7)] + [np.full(n, 3.0), np.zeros(n), np.arange(n) * 2.0, -noisy(n, 9, m)])
    found = fit_states(values, m)
    for b, y in enumerate(values):
        np.testing.assert_allclose(carried(found, b, n, 14), fit_forecast(y, m, 14), rtol=0, atol=1e-9 * max(1.0, np.abs(y).max()))


def test_a_batch_larger_than_one_part(monkeypatch):
    from orderlens.operators import holt_winters as hw

    values = np.array([noisy(30, s) for s in range(9)])
    whole = fit_states(values, 12)
    monkeypatch.setattr(hw, "_AT_ONCE", 27 * 30 * 15 * 2)
    for one, other in zip(whole, fit_states(values, 12), strict=True):
        np.testing.assert_allclose(one, other, rtol=0, atol=1e-9)


def test_states_in_spark_equal_the_single_fit(spark):
    values = {f"s{i}": noisy(24 + i % 4, i) for i in range(40)} | {"short": [1.0, 5.0]}
    got = {}
    for r in forecast_series(series(spark, values).repartition(7), 3).collect():
        got.setdefault((r["series_key"], r["model"]), {})[r["step"]] = r["y_hat"]
    assert got.pop(("short", TOO_SHORT)) == {1: None, 2: None, 3: None}
    assert len(got) == 40
    for (key, model), path in got.items():
        assert model == HOLT_WINTERS
        np.testing.assert_allclose([path[h] for h in (1, 2, 3)], fit_forecast(np.array(values[key]), 12, 3), atol=1e-9)


def test_weekly_periods_follow_the_last(spark):
    rows = [("a", datetime.date(2017, 1, 1) + datetime.timedelta(7 * i), float(i % 5)) for i in range(30)]
    frame = spark.createDataFrame(rows, "series_key string, period date, y double")
    states = holt_winters_states(series_arrays(frame), "week", season=13)
    ahead = forecast_states(states, 2, "week").orderBy("step").collect()
    assert [r["period"] for r in ahead] == [rows[-1][1] + datetime.timedelta(7 * h) for h in (1, 2)]


def test_best_of_three_and_forward_by_the_best(spark):
    rng = np.random.default_rng(1)
    walk = np.r_[np.full(40, 50.0), np.full(8, 80.0)]
    values = {
        "seasonal": 100 + 2 * np.arange(48) + 30 * np.sin(2 * np.pi * np.arange(48) / 12),
        "level": np.r_[50 + rng.normal(0, 8, 38), 46.0, 54.0, 48.0, 52.0, [50.0] * 6],
        "walk": np.r_[walk[:42], [80.0] * 6],
        "brief": [1.0, 2.0, 3.0],
    }
    frame = series(spark, values)
    split = ts.ts_time_split(frame, 6)
    predictions = ts.ts_model_predictions(split, 6)
    models = {(r["series_key"], r["model"]) for r in predictions.select("series_key", "model").distinct().collect()}
    assert models == {(k, m) for k in ("seasonal", "level", "walk") for m in (NAIVE, MOVING_AVERAGE, HOLT_WINTERS)}
    best = ts.ts_best_model(ts.ts_accuracy(predictions))
    chosen = {r["series_key"]: r["best_model"] for r in best.collect()}
    assert chosen["seasonal"] == HOLT_WINTERS and chosen["level"] == MOVING_AVERAGE and set(chosen) == {"seasonal", "level", "walk"}
    forward = {}
    for r in ts.ts_forward(frame, best, 4).orderBy("period").collect():
        forward.setdefault((r["series_key"], r["model"]), []).append((r["period"], r["y_hat"]))
    assert set(forward) == {*chosen.items(), ("brief", NAIVE)}
    assert [p for p, _ in forward["seasonal", HOLT_WINTERS]] == [month(48 + h) for h in range(4)]
    expected = 100 + 2 * np.arange(48, 52) + 30 * np.sin(2 * np.pi * np.arange(48, 52) / 12)
    np.testing.assert_allclose([v for _, v in forward["seasonal", HOLT_WINTERS]], expected, atol=1e-3)
    assert [v for _, v in forward["level", MOVING_AVERAGE]] == [50.0] * 4
    assert [v for _, v in forward["brief", NAIVE]] == [3.0] * 4


def test_baselines_equal_the_states(spark):
    split = ts.ts_time_split(series(spark, {"a": noisy(30, 1), "b": noisy(9, 2), "c": [4.0] * 7}), 6)
    plain = ts.ts_naive_forecast(split).unionByName(ts.ts_moving_average_forecast(split))
    stated = ts.ts_model_predictions(split, 6).filter(f"model IN ('{NAIVE}', '{MOVING_AVERAGE}')")
    assert plain.count() == 36
    both = [sorted((r["series_key"], r["period"], r["model"], round(r["y_hat"], 9)) for r in f.collect()) for f in (plain, stated)]
    assert both[0] == both[1]


def test_a_model_without_forecasts_never_wins(spark):
    split = ts.ts_time_split(series(spark, {"a": noisy(20, 3)}), 6)
    (best,) = ts.ts_best_model(ts.ts_accuracy(ts.ts_model_predictions(split, 6))).collect()
    assert best["best_model"] in (NAIVE, MOVING_AVERAGE)


def test_no_cartesian_product_without_a_key(spark):
    frame = series(spark, {"x": noisy(30, 1)}).selectExpr("'all' AS series_key", "period", "y")
    split = ts.ts_time_split(frame, 6)
    for made in (ts.ts_naive_forecast(split), ts.ts_moving_average_forecast(split)):
        plan = made._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and made.count() == 6


def test_only_changed_series_are_fitted_again(spark, tmp_path):
    values = {k: list(noisy(30, i)) for i, k in enumerate(("a", "b", "c"))}
    store = ForecastStore(spark, str(tmp_path / "states"))
    assert store.refresh(series(spark, values)) == 3
    first = store.forward(4).orderBy("series_key", "period").collect()
    assert len(first) == 12
    assert store.refresh(series(spark, values).repartition(5)) == 0
    assert store.forward(4).orderBy("series_key", "period").collect() == first
    values["b"][-1] += 50
    assert store.refresh(series(spark, values)) == 1
    versions = {r["series_key"]: r["fitted_version"] for r in store.states().collect()}
    assert versions == {"a": 1, "b": 2, "c": 1}
    expected = {r["series_key"]: r["y_hat"] for r in forecast_series(series(spark, values), 1).collect()}
    got = {r["series_key"]: r["y_hat"] for r in store.forward(1).collect()}
    assert got == pytest.approx(expected, abs=1e-9)
    del values["a"]
    values["d"] = list(noisy(26, 9))
    assert store.refresh(series(spark, values)) == 1
    assert {r["series_key"] for r in store.states().collect()} == {"b", "c", "d"}


def test_other_options_refit_all(spark, tmp_path):
    frame = series(spark, {"a": noisy(30, 1), "b": noisy(30, 2)})
    assert ForecastStore(spark, str(tmp_path / "s")).refresh(frame) == 2
    assert ForecastStore(spark, str(tmp_path / "s"), season=6).refresh(frame) == 2
    assert ForecastStore(spark, str(tmp_path / "s"), season=6).refresh(frame) == 0


def test_lookup_reads_states(spark, tmp_path):
    store = ForecastStore(spark, str(tmp_path / "s"))
    store.refresh(series(spark, {"all": noisy(30, 1), "Fishing": noisy(30, 2), "Golf": noisy(30, 3)}))
    forward = {(r["series_key"], r["period"]): r["y_hat"] for r in store.forward(2).collect()}
    for name, key in (("FISHING", "Fishing"), ("unknown", "all"), ("golf", "Golf")):
        found = store.lookup(name, 2).collect()
        assert {(r["series_key"], r["period"]): r["y_hat"] for r in found} == {k: v for k, v in forward.items() if k[0] == key}
