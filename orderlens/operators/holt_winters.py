"""Additive Holt-Winters (level, trend, season), fitted for many series in one numpy call.

Spark has no exponential smoothing, so series are fitted in tasks. A series is a row with an array
of its periods, a few hundred values at most, never raw lines; a task gets batches of such rows and
fits all series of one length together. A total over everything is a series among the others.

In error-correction form the one-step errors are linear in the initial level, trend and
seasonal values. For given smoothing weights the best initial state is therefore a least
squares solution, and only the three weights are searched: first on a grid, then on grids
shrinking around the best point. How errors depend on the initial state does not depend on the
values, so the grid's equations are set up once for all series of a length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLT_WINTERS = "holt_winters"
FALLBACK = "moving_average_fallback"
_REFINEMENTS = 6


#: Periods of a season, the same for every series.
SEASONS = {"month": 12, "week": 52}
TOO_SHORT = "too_short"


def season_by_length(n: int, freq: str) -> int:
    """Twelve months; 52 weeks when more than 104 are known, otherwise 13.

    Series of one run then differ in their season, so their errors are not comparable.
    """
    if freq == "month":
        return 12
    return 52 if n > 104 else 13


def _smooth(y: np.ndarray, m: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray):
    """Errors and final states as linear functions of the initial state, per candidate.

    The last axis holds one coefficient per initial value (level, trend, m - 1 seasons;
    the last season is minus the sum of the others) and the constant part.
    """
    n_candidates, k = len(alpha), m + 1
    level = np.zeros((n_candidates, k + 1))
    trend = np.zeros_like(level)
    season = np.zeros((n_candidates, m, k + 1))
    level[:, 0] = 1.0
    trend[:, 1] = 1.0
    for j in range(m - 1):
        season[:, j, 2 + j] = 1.0
        season[:, m - 1, 2 + j] = -1.0
    errors = np.empty((n_candidates, len(y), k + 1))
    for t, value in enumerate(y):
        e = -(level + trend + season[:, t % m])
        e[:, k] += value
        errors[:, t] = e
        level = level + trend + alpha[:, None] * e
        trend = trend + beta[:, None] * e
        season[:, t % m] += gamma[:, None] * e
    return errors, level, trend, season


def _best_start(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Initial state minimising the squared error of each candidate, and that error."""
    a, c = errors[:, :, :-1], errors[:, :, -1]
    gram = np.einsum("ptk,ptl->pkl", a, a)
    scale = np.trace(gram, axis1=1, axis2=2)[:, None, None] / gram.shape[1]
    gram = gram + 1e-10 * scale * np.eye(gram.shape[1])
    start = -np.linalg.solve(gram, np.einsum("ptk,pt->pk", a, c)[:, :, None])[:, :, 0]
    residual = c + np.einsum("ptk,pk->pt", a, start)
    return start, np.einsum("pt,pt->p", residual, residual)


def fit_forecast(values: np.ndarray, m: int, horizon: int) -> np.ndarray:
    """Forecasts for steps 1..horizon. Needs at least two full seasons."""
    scale = float(np.max(np.abs(values))) or 1.0
    y = values / scale
    n = len(y)

    def evaluate(points: np.ndarray):
        alpha = points[:, 0]
        beta, gamma = alpha * points[:, 1], (1.0 - alpha) * points[:, 2]
        errors, level, trend, season = _smooth(y, m, alpha, beta, gamma)
        start, sse = _best_start(errors)
        i = int(np.argmin(sse))
        state = np.append(start[i], 1.0)
        seasons = season[i] @ state
        steps = np.arange(1, horizon + 1)
        path = level[i] @ state + steps * (trend[i] @ state) + seasons[(n + steps - 1) % m]
        return points[i], float(sse[i]), path

    axis = np.array([0.0, 0.05, 0.2, 0.5, 0.8, 1.0])
    grid = np.array(np.meshgrid([0.005, 0.05, 0.15, 0.3, 0.5, 0.75, 0.95], axis, axis)).reshape(3, -1).T
    point, sse, path = evaluate(grid)
    width = 0.12
    offsets = np.array(np.meshgrid(*[[-1.0, 0.0, 1.0]] * 3)).reshape(3, -1).T
    for _ in range(_REFINEMENTS):
        candidate, candidate_sse, candidate_path = evaluate(np.clip(point + width * offsets, 0.0001, 1.0))
        if candidate_sse < sse:
            point, sse, path = candidate, candidate_sse, candidate_path
        width /= 2.0
    return path * scale


def _axes() -> np.ndarray:
    """Points of the first grid: the level's weight, and the shares that give the other two."""
    axis = np.array([0.0, 0.05, 0.2, 0.5, 0.8, 1.0])
    return np.array(np.meshgrid([0.005, 0.05, 0.15, 0.3, 0.5, 0.75, 0.95], axis, axis)).reshape(3, -1).T


def _weights(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alpha = points[..., 0]
    return alpha, alpha * points[..., 1], (1.0 - alpha) * points[..., 2]


def _responses(n: int, m: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the errors of each point depend on the initial state, and the inverse of the normal equations."""
    errors = _smooth(np.zeros(n), m, *_weights(points))[0][:, :, :-1]
    gram = np.einsum("ptk,ptl->pkl", errors, errors)
    scale = np.trace(gram, axis1=1, axis2=2)[:, None, None] / gram.shape[1]
    return errors, np.linalg.inv(gram + 1e-10 * scale * np.eye(gram.shape[1]))


def _errors_from_zero(y: np.ndarray, m: int, points: np.ndarray) -> np.ndarray:
    """One-step errors from a zero initial state: ``y`` is (series, 1 or points, periods), points (..., 3)."""
    alpha, beta, gamma = _weights(points)
    shape = np.broadcast_shapes(y.shape[:-1], alpha.shape)
    level, trend = np.zeros(shape), np.zeros(shape)
    season = np.zeros((m, *shape))
    errors = np.empty((*shape, y.shape[-1]))
    for t in range(y.shape[-1]):
        e = y[..., t] - (level + trend + season[t % m])
        errors[..., t] = e
        level = level + trend + alpha * e
        trend = trend + beta * e
        season[t % m] += gamma * e
    return errors


def _final_states(y: np.ndarray, m: int, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and seasons after the last period, of one point and initial state per series."""
    alpha, beta, gamma = _weights(points)
    level, trend = start[:, 0].copy(), start[:, 1].copy()
    season = np.concatenate([start[:, 2:], -start[:, 2:].sum(axis=1, keepdims=True)], axis=1)
    for t in range(y.shape[1]):
        e = y[:, t] - (level + trend + season[:, t % m])
        level = level + trend + alpha * e
        trend = trend + beta * e
        season[:, t % m] += gamma * e
    return level, trend, season


#: Numbers held at once while series are fitted together.
_AT_ONCE = 1 << 22


def fit_states(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Final level, trend, seasons and weights of many series of equal length, a row each.

    Needs at least two full seasons. The season of forecast step h is entry ``(n + h - 1) % m``.
    """
    n, k = values.shape[1], m + 1
    found = [np.empty(len(values)), np.empty(len(values)), np.empty((len(values), m)), np.empty((len(values), 3))]
    grid = _axes()
    design, inverse = _responses(n, m, grid)
    offsets = np.array(np.meshgrid(*[[-1.0, 0.0, 1.0]] * 3)).reshape(3, -1).T
    step = max(1, _AT_ONCE // max(len(offsets) * n * (k + 2), len(grid) * n))
    for first in range(0, len(values), step):
        part = values[first : first + step]
        scale = np.max(np.abs(part), axis=1)
        scale[scale == 0.0] = 1.0
        y = part / scale[:, None]
        rows = np.arange(len(y))
        c = _errors_from_zero(y[:, None, :], m, grid)
        start = -np.einsum("pkl,bpl->bpk", inverse, np.einsum("ptk,bpt->bpk", design, c, optimize=True), optimize=True)
        residual = c + np.einsum("ptk,bpk->bpt", design, start, optimize=True)
        errors = np.einsum("bpt,bpt->bp", residual, residual)
        best = errors.argmin(axis=1)
        point, sse, begin = grid[best], errors[rows, best], start[rows, best]
        width = 0.12
        for _ in range(_REFINEMENTS):
            near = np.clip(point[:, None, :] + width * offsets, 0.0001, 1.0)
            distinct, which = np.unique(near.reshape(-1, 3), axis=0, return_inverse=True)
            which = which.reshape(len(y), len(offsets))
            own, inverses = _responses(n, m, distinct)
            c = _errors_from_zero(y[:, None, :], m, near)
            right = np.empty((len(y), len(offsets), k))
            for b in rows:
                right[b] = np.matmul(c[b][:, None, :], own[which[b]])[:, 0]
            start = -np.matmul(inverses[which], right[..., None])[..., 0]
            for b in rows:
                c[b] += np.matmul(own[which[b]], start[b][..., None])[..., 0]
            errors = np.einsum("bpt,bpt->bp", c, c)
            best = errors.argmin(axis=1)
            better = errors[rows, best] < sse
            point = np.where(better[:, None], near[rows, best], point)
            begin = np.where(better[:, None], start[rows, best], begin)
            sse = np.where(better, errors[rows, best], sse)
            width /= 2.0
        level, trend, season = _final_states(y, m, point, begin)
        end = first + len(y)
        found[0][first:end], found[1][first:end] = level * scale, trend * scale
        found[2][first:end] = season * scale[:, None]
        found[3][first:end] = np.stack(_weights(point), axis=1)
    return tuple(found)


#: A fitted series: forecast step h is ``level + h * trend + season[(n + h - 1) % size(season)]``.
STATE = (
    "series_key string, model string, n int, last date, values_hash long, level double, trend double,"
    " season array<double>, weights array<double>"
)
NAIVE = "naive_last_value"
MOVING_AVERAGE = "moving_average_4"
#: Values averaged by the moving average.
RECENT_PERIODS = 4


def series_arrays(series: DataFrame) -> DataFrame:
    """``series_key, n, last, values, values_hash``: each series as one row, its values by period."""
    points = F.sort_array(F.collect_list(F.struct("period", F.col("y").cast("double").alias("y"))))
    return (
        series.groupBy("series_key")
        .agg(points.alias("points"))
        .select(
            "series_key",
            F.size("points").alias("n"),
            F.element_at("points", -1)["period"].cast("date").alias("last"),
            F.col("points.y").alias("values"),
            F.xxhash64("points").alias("values_hash"),
        )
    )


def _constant_states(arrays: DataFrame, model: str, level: Column) -> DataFrame:
    none = F.lit(None).cast("array<double>")
    return arrays.select(
        "series_key",
        F.lit(model).alias("model"),
        "n",
        "last",
        "values_hash",
        level.alias("level"),
        F.lit(0.0).alias("trend"),
        none.alias("season"),
        none.alias("weights"),
    )


def naive_states(arrays: DataFrame) -> DataFrame:
    """The last value of each series as its level."""
    return _constant_states(arrays, NAIVE, F.element_at("values", -1))


def moving_average_states(arrays: DataFrame, n: int = RECENT_PERIODS) -> DataFrame:
    """The mean of the last ``n`` values of each series as its level."""
    last = F.slice("values", F.greatest(F.size("values") - n + 1, F.lit(1)), n)
    total = F.aggregate(last, F.lit(0.0), lambda s, v: s + v)
    return _constant_states(arrays, MOVING_AVERAGE, total / F.size(last))


def holt_winters_states(
    arrays: DataFrame,
    freq: str = "month",
    season: int | Callable[[int, str], int] | None = None,
    short_series: str = "null",
) -> DataFrame:
    """One fitted state per series of ``series_arrays``.

    ``season`` is a number of periods (by default that of ``freq``) or a rule such as
    ``season_by_length``. A series shorter than two seasons is never left out: with
    ``short_series="null"`` its level is null and the model is ``too_short``, with
    ``"moving_average"`` its level is the mean of its last four values, under a name of its own.
    Series are dealt by key to as many tasks as the session shuffles to: rows are small, but fits are not.
    """
    if short_series not in ("null", "moving_average"):
        raise ValueError(f"short_series={short_series!r}")
    season = SEASONS[freq] if season is None else season

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("values"))
            lengths = batch.column(batch.schema.get_field_index("n")).to_numpy()
            rows = len(lengths)
            model = np.full(rows, TOO_SHORT, dtype=object)
            level, trend = np.full(rows, np.nan), np.zeros(rows)
            seasons: list[list[float] | None] = [None] * rows
            weights: list[list[float] | None] = [None] * rows
            for n in np.unique(lengths).tolist():
                m = season(n, freq) if callable(season) else season
                mine = np.flatnonzero(lengths == n)
                y = values.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), n)
                if n >= 2 * m:
                    level[mine], trend[mine], found, used = fit_states(y, m)
                    model[mine] = HOLT_WINTERS
                    for i, row in enumerate(mine.tolist()):
                        seasons[row], weights[row] = found[i].tolist(), used[i].tolist()
                elif short_series == "moving_average":
                    model[mine], level[mine] = FALLBACK, y[:, -RECENT_PERIODS:].mean(axis=1)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("series_key", "n", "last", "values_hash")]
            made = [
                kept[0],
                pa.array(model, pa.string()),
                *kept[1:],
                pa.array(level, mask=np.isnan(level)),
                pa.array(trend),
                pa.array(seasons, pa.list_(pa.float64())),
                pa.array(weights, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in STATE.split(", ")])

    tasks = int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrays.repartition(tasks, "series_key").mapInArrow(run, STATE)


def forecast_states(states: DataFrame, horizon: int, freq: str = "month") -> DataFrame:
    """``series_key, step, period, model, y_hat`` for steps 1..horizon, from states alone."""
    steps = states.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    place = (F.col("n") + F.col("step") - 1) % F.greatest(F.size("season"), F.lit(1))
    period = F.add_months("last", F.col("step")) if freq == "month" else F.date_add("last", F.col("step") * 7)
    season = F.coalesce(F.get("season", place), F.lit(0.0))
    return steps.select(
        "series_key",
        "step",
        period.alias("period"),
        "model",
        (F.col("level") + F.col("step") * F.col("trend") + season).alias("y_hat"),
    )


def forecast_series(
    train: DataFrame,
    horizon: int,
    freq: str = "month",
    season: int | Callable[[int, str], int] | None = None,
    short_series: str = "null",
) -> DataFrame:
    """``(series_key, step, model, y_hat)`` for steps 1..horizon of every series; options as in ``holt_winters_states``."""
    states = holt_winters_states(series_arrays(train), freq, season, short_series)
    return forecast_states(states, horizon, freq).drop("period")
