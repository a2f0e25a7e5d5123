"""Demand series per key: aggregation, splits, baseline forecasts, accuracy.

A series is ``(series_key, period, y)``; without a key there is one series named "all".
Lines are summed to periods before anything else, so every later window, join or group
holds at most the periods of one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money
from .holt_winters import (
    MOVING_AVERAGE,
    NAIVE,
    RECENT_PERIODS,
    forecast_series,
    forecast_states,
    holt_winters_states,
    moving_average_states,
    naive_states,
    series_arrays,
)

# Percentage change up to which replenishment is held.
HOLD_BAND_PCT = 5.0

_ALL = "all"


def _key(key: str | None) -> Column:
    return (F.lit(_ALL) if key is None else F.col(key).cast("string")).alias("series_key")


def ts_monthly_demand(fact: DataFrame, key: str | None = None) -> DataFrame:
    """Units and sales per series and month (month start date)."""
    return (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy(_key(key), F.trunc("order_date", "MM").alias("period"))
        .agg(
            F.sum("order_item_quantity").alias("quantity"),
            money(F.sum("sales")).alias("sales"),
        )
    )


def week_ending(column: str) -> Column:
    """The Sunday on or after a date."""
    return F.next_day(F.date_sub(F.col(column).cast("date"), 1), "SUN")


def fill_calendar(series: DataFrame, step: str) -> DataFrame:
    """Add missing periods with y = 0, from each series' first period to the last of all.

    The calendar is exploded per series, so it is as large as its result.
    """
    last = series.agg(F.max("period")).scalar()
    spans = series.groupBy("series_key").agg(F.min("period").alias("first"))
    grid = spans.select(
        "series_key", F.explode(F.sequence(F.col("first"), last, F.expr(f"interval {step}"))).alias("period")
    )
    return grid.join(series, ["series_key", "period"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def monthly_series(fact: DataFrame, key: str | None = None) -> DataFrame:
    """Units per month as a gapless series."""
    monthly = (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy(_key(key), F.trunc("order_date", "MM").alias("period"))
        .agg(F.sum("order_item_quantity").cast("double").alias("y"))
    )
    return fill_calendar(monthly, "1 month")


def ts_weekly_demand(fact: DataFrame, key: str | None = None) -> DataFrame:
    """Units per week ending Sunday, empty weeks as zero, without the last (partial) week."""
    weekly = (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy(_key(key), week_ending("order_date").alias("period"))
        .agg(F.sum("order_item_quantity").cast("double").alias("y"))
    )
    last = weekly.agg(F.max("period")).scalar()
    return fill_calendar(weekly, "7 days").filter(F.col("period") < last)


def ts_exclude_tail(series: DataFrame, cutoff: str) -> DataFrame:
    """Periods up to and including the cutoff date."""
    return series.filter(F.col("period") <= F.lit(cutoff).cast("date"))


def ts_excluded_periods(series: DataFrame, cutoff: str) -> DataFrame:
    """Number and range of the periods after the cutoff, per series."""
    return (
        series.filter(F.col("period") > F.lit(cutoff).cast("date"))
        .groupBy("series_key")
        .agg(
            F.count("*").alias("n_excluded"),
            F.min("period").alias("first_excluded"),
            F.max("period").alias("last_excluded"),
        )
    )


def ts_time_split(series: DataFrame, test_size: int) -> DataFrame:
    """Add ``part``: the last ``test_size`` periods of each series are "test", others "train".

    ``step`` numbers the test periods from 1.
    """
    age = F.row_number().over(Window.partitionBy("series_key").orderBy(F.col("period").desc()))
    return series.withColumn("_age", age).select(
        *series.columns,
        F.when(F.col("_age") <= test_size, "test").otherwise("train").alias("part"),
        F.when(F.col("_age") <= test_size, test_size + 1 - F.col("_age")).cast("int").alias("step"),
    )


def _parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = split.filter(F.col("part") == "train").select("series_key", "period", "y")
    test = split.filter(F.col("part") == "test").select("series_key", "period", "step", "y")
    return train, test


def _constant_forecast(split: DataFrame, y_hat: Column, model: str) -> DataFrame:
    """Test periods with a value computed over the training part of their series, in one pass over it."""
    return split.withColumn("y_hat", y_hat).filter(F.col("part") == "test").select(
        "series_key", "period", F.lit(model).alias("model"), "y", "y_hat"
    )


def ts_naive_forecast(split: DataFrame) -> DataFrame:
    """The last training value, repeated; null where a series has no training part."""
    train = F.col("part") == "train"
    last = F.max_by(F.when(train, F.col("y")), F.when(train, F.col("period")))
    return _constant_forecast(split, last.over(Window.partitionBy("series_key")), NAIVE).filter("y_hat IS NOT NULL")


def recent_mean(train: DataFrame, n: int = RECENT_PERIODS) -> DataFrame:
    """Mean of the last ``n`` values of each series."""
    age = F.row_number().over(Window.partitionBy("series_key").orderBy(F.col("period").desc()))
    return (
        train.withColumn("_age", age)
        .filter(F.col("_age") <= n)
        .groupBy("series_key")
        .agg(F.avg("y").alias("y_hat"))
    )


def ts_moving_average_forecast(split: DataFrame, n: int = RECENT_PERIODS) -> DataFrame:
    """The mean of the last ``n`` training values, held constant."""
    age = F.row_number().over(Window.partitionBy("series_key", "part").orderBy(F.col("period").desc()))
    recent = F.when((F.col("part") == "train") & (F.col("_age") <= n), F.col("y"))
    mean = F.avg(recent).over(Window.partitionBy("series_key"))
    return _constant_forecast(split.withColumn("_age", age), mean, MOVING_AVERAGE).filter("y_hat IS NOT NULL")


def ts_holt_winters(split: DataFrame, test_size: int, freq: str = "month", **options) -> DataFrame:
    """Additive Holt-Winters fitted per series on its training part; ``options`` as in ``forecast_series``."""
    train, test = _parts(split)
    forecast = forecast_series(train, test_size, freq, **options)
    return test.join(forecast, ["series_key", "step"]).select("series_key", "period", "model", "y", "y_hat")


def ts_refit_forward(series: DataFrame, horizon: int = 6, freq: str = "month", **options) -> DataFrame:
    """Refit on every period of each series and forecast the next ``horizon`` periods."""
    ends = series.groupBy("series_key").agg(F.max("period").alias("last"))
    ahead = F.add_months("last", F.col("step")) if freq == "month" else F.date_add("last", F.col("step") * 7)
    return (
        forecast_series(series, horizon, freq, **options)
        .join(ends, "series_key")
        .select("series_key", ahead.alias("period"), "model", "y_hat")
    )


def ts_model_predictions(split: DataFrame, test_size: int, freq: str = "month", **options) -> DataFrame:
    """Test periods with the forecasts of all three models, each fitted on the training part.

    A series too short for Holt-Winters has null forecasts under that model's short name.
    """
    train, test = _parts(split)
    arrays = series_arrays(train)
    states = (
        naive_states(arrays)
        .unionByName(moving_average_states(arrays))
        .unionByName(holt_winters_states(arrays, freq, **options))
    )
    ahead = forecast_states(states, test_size, freq).drop("period")
    return test.join(ahead, ["series_key", "step"]).select("series_key", "period", "model", "y", "y_hat")


def ts_forward(series: DataFrame, best: DataFrame, horizon: int = 6, freq: str = "month", **options) -> DataFrame:
    """The next ``horizon`` periods by each series' best model, refitted on all its periods.

    ``best`` is ``ts_best_model``; a series that is not in it (too short to be tested) repeats its last
    value. Only series whose best model is Holt-Winters are fitted.
    """
    chosen = series_arrays(series).join(best.select("series_key", "best_model"), "series_key", "left")
    chosen = chosen.withColumn("best_model", F.coalesce("best_model", F.lit(NAIVE)))

    def of(model: str) -> DataFrame:
        return chosen.filter(F.col("best_model") == model).drop("best_model")

    smoothed = ~F.col("best_model").isin(NAIVE, MOVING_AVERAGE)
    states = (
        naive_states(of(NAIVE))
        .unionByName(moving_average_states(of(MOVING_AVERAGE)))
        .unionByName(holt_winters_states(chosen.filter(smoothed).drop("best_model"), freq, **options))
    )
    return forecast_states(states, horizon, freq).select("series_key", "period", "model", "y_hat")


def ts_accuracy(predictions: DataFrame, digits: int = 2) -> DataFrame:
    """MAE and RMSE per series and model."""
    error = F.col("y") - F.col("y_hat")
    return predictions.groupBy("series_key", "model").agg(
        F.round(F.avg(F.abs(error)), digits).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), digits).alias("rmse"),
    )


def ts_best_model(accuracy: DataFrame, baseline: str = NAIVE) -> DataFrame:
    """The model with the lowest RMSE per series, and its MAE gain over the baseline; models without forecasts never win."""
    best = accuracy.groupBy("series_key").agg(
        F.min_by(F.struct("model", "rmse", "mae"), F.when(F.col("rmse").isNotNull(), F.struct("rmse", "model"))).alias("best"),
        F.max(F.when(F.col("model") == baseline, F.col("mae"))).alias("base"),
    )
    gain = 100 * (1 - F.try_divide(F.col("best.mae"), F.col("base")))
    return best.select(
        "series_key",
        F.col("best.model").alias("best_model"),
        F.col("best.rmse").alias("rmse"),
        F.round(gain, 1).alias("improvement_over_baseline_pct"),
    )


def ts_planning_signal(train: DataFrame, forecast: DataFrame, n: int = RECENT_PERIODS) -> DataFrame:
    """Next ``n`` forecast periods against the last ``n`` actual ones, as a replenishment signal.

    ``forecast`` is ``(series_key, period, y_hat)``.
    """
    order = F.row_number().over(Window.partitionBy("series_key").orderBy("period"))
    ahead = (
        forecast.withColumn("_rank", order)
        .filter(F.col("_rank") <= n)
        .groupBy("series_key")
        .agg(F.avg("y_hat").alias("ahead"))
    )
    recent = recent_mean(train, n).withColumnRenamed("y_hat", "recent")
    change = F.round(F.try_divide(100 * (F.col("ahead") - F.col("recent")), F.col("recent")), 1)
    signal = (
        F.when(F.col("pct_change").isNull(), F.lit(None).cast("string"))
        .when(F.col("pct_change") > HOLD_BAND_PCT, "increase")
        .when(F.col("pct_change") >= -HOLD_BAND_PCT, "hold")
        .otherwise("taper")
    )
    return (
        ahead.join(recent, "series_key")
        .withColumn("pct_change", change)
        .select(
            "series_key",
            F.round("ahead", 1).alias("next_avg"),
            F.round("recent", 1).alias("recent_avg"),
            "pct_change",
            signal.alias("signal"),
        )
    )


def ts_actual_vs_forecast(
    split: DataFrame, predictions: Sequence[DataFrame], forward: DataFrame | None = None
) -> DataFrame:
    """Actuals, test predictions and forward forecast in one long table with a ``series`` label."""
    actual = split.select("series_key", "period", F.concat(F.lit("actual_"), "part").alias("series"), F.col("y").alias("value"))
    result = actual
    for frame in predictions:
        result = result.unionByName(
            frame.select("series_key", "period", F.col("model").alias("series"), F.col("y_hat").alias("value"))
        )
    if forward is not None:
        result = result.unionByName(
            forward.select(
                "series_key", "period", F.concat(F.lit("forward_"), "model").alias("series"), F.col("y_hat").alias("value")
            )
        )
    return result


def ts_flatline_check(series: DataFrame, window: int = 8, max_cv: float = 0.01) -> DataFrame:
    """Rolling variability; ``is_flat`` marks a full window that hardly varies."""
    span = Window.partitionBy("series_key").orderBy("period").rowsBetween(1 - window, 0)
    rolled = series.withColumns(
        {
            "_n": F.count("*").over(span),
            "_cv": F.try_divide(F.stddev_samp("y").over(span), F.avg("y").over(span)),
        }
    )
    return rolled.select(
        "series_key",
        "period",
        "y",
        F.round("_cv", 4).alias("rolling_cv"),
        F.coalesce((F.col("_n") == window) & (F.col("_cv") < max_cv), F.lit(False)).alias("is_flat"),
    )


def forecast_lookup(forward: DataFrame, name: str) -> DataFrame:
    """Forward forecast of one series, ignoring case; the total where there is no such series."""
    own = forward.filter(F.lower("series_key") == name.lower())
    found = own.agg(F.count("*") > 0).scalar()
    total = forward.filter((F.col("series_key") == _ALL) & ~found)
    return own.unionByName(total)


