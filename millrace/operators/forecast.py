"""Forecasts for many daily series at once.

Inputs are daily rows, so a series holds one row per day whatever the volume of events. Smoothing and the search over models work on
a row per series, many series of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lags of the autoregression, days held out, width of the bounds in residual deviations.
LAGS, HOLDOUT_DAYS, BOUND = 7, 7, 1.28
# The grid of the smoothing: gains of level and trend, damping.
ALPHAS, BETAS, DAMPINGS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.2, 0.5), (0.8, 0.9, 0.98)
MAX_CELLS = 4_000_000  # numbers of a matrix held at once by a task


def sequences(daily: DataFrame, keys: Sequence[str], length: int = LAGS, ds: str = "ds", y: str = "y") -> DataFrame:
    """The ``length`` previous values as ``x`` (oldest first); rows without enough history are left out."""
    before = Window.partitionBy(*keys).orderBy(ds).rowsBetween(-length, -1)
    return daily.withColumn("x", F.collect_list(y).over(before)).filter(F.size("x") == length)


def time_split(daily: DataFrame, keys: Sequence[str], holdout: int = HOLDOUT_DAYS, ds: str = "ds") -> DataFrame:
    """The last ``holdout`` rows of each series are ``val``."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ds)))
    return daily.withColumn("split", F.when(newest <= holdout, "val").otherwise("train"))


def fit_trend(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linear trend and multiplicative weekday index per series, by aggregation only."""
    keys = list(keys)
    line = train.groupBy(*keys).agg(F.min("ds").alias("origin"), F.max("ds").alias("last_ds"))
    timed = train.join(line, keys).withColumn("t", F.datediff("ds", "origin").cast("double"))
    fit = timed.groupBy(*keys).agg(
        F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.avg("y").alias("mean"))
    trended = timed.join(fit, keys).withColumn("trend", F.coalesce(F.col("intercept") + F.col("slope") * F.col("t"), F.col("mean")))
    weekday = trended.groupBy(*keys, F.weekday("ds").alias("wd")).agg(F.avg(F.try_divide("y", "trend")).alias("index"))
    fitted = trended.withColumn("wd", F.weekday("ds")).join(weekday, [*keys, "wd"])
    spread = fitted.groupBy(*keys).agg(F.stddev_samp(F.col("y") - F.col("trend") * F.col("index")).alias("sigma"))
    packed = weekday.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("wd", "index"))).alias("weekly"))
    return line.join(fit, keys).join(spread, keys).join(packed, keys)


def forecast_range(model: DataFrame, keys: Sequence[str], start, end) -> DataFrame:
    """Trend times weekday index with bounds for every day of the range (a weekday never seen counts as 1)."""
    days = model.withColumn("ds", F.explode(F.sequence(start, end)))
    trend = F.coalesce(F.col("intercept") + F.col("slope") * F.datediff("ds", "origin"), F.col("mean"))
    point = trend * F.coalesce(F.element_at("weekly", F.weekday("ds")), F.lit(1.0))
    half = F.coalesce(F.col("sigma"), F.lit(0.0)) * BOUND
    return days.select(*keys, "ds", point.alias("forecast"), (point - half).alias("lower_bound"), (point + half).alias("upper_bound"))


def mean_forecast(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fallback of every model: the mean of the training days."""
    return train.groupBy(*keys).agg(F.avg("y").alias("forecast"))


# ---------------------------------------------------------------- exponential smoothing

def series_arrays(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: ``days`` (numbers of days) and ``values`` in the order of time, and the last day.

    A series has a row per day, so its arrays are short. Days without a finite value are left out of the arrays.
    """
    finite = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    point = F.struct(F.unix_date("ds").alias("day"), F.col("y").cast("double").alias("y"))
    rows = daily.groupBy(*keys).agg(F.max("ds").alias("last_ds"), F.array_sort(F.collect_list(F.when(finite, point))).alias("_points"))
    return rows.select(*keys, "last_ds", F.col("_points.day").alias("days"), F.col("_points.y").alias("values"))


def smoothing_grid(damped: bool = True, trend: bool = True) -> np.ndarray:
    """The (alpha, beta, phi) that are tried."""
    betas, phis = (BETAS, DAMPINGS if damped else (1.0,)) if trend else ((0.0,), (0.0,))
    return np.array([(a, b, p) for a in ALPHAS for b in betas for p in phis])


def slices(lengths: np.ndarray, width: int) -> list[np.ndarray]:
    """Positions of series, longest first, in groups whose padded matrix holds ``MAX_CELLS`` numbers at most (one series at least)."""
    order = np.argsort(-lengths, kind="stable")
    groups, start = [], 0
    while start < len(order):
        rows = max(1, MAX_CELLS // (max(1, int(lengths[order[start]])) * width))
        groups.append(order[start:start + rows])
        start += rows
    return groups


def padded(values: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix with a row per series, 0 behind its end; lengths)."""
    lengths = np.array([len(v) for v in values])
    out = np.zeros((len(values), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate([np.zeros(0), *values])
    return out, lengths


def smooth(y: np.ndarray, lengths: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared error, level, trend) of every series, longest first, for every point of the grid."""
    alpha, beta, phi = grid.T
    gain = alpha * beta
    level = np.repeat(y[:, :1], len(grid), axis=1)
    slope = np.repeat(y[:, 1:2] - y[:, :1], len(grid), axis=1)
    error = np.zeros_like(level)
    for t in range(1, y.shape[1]):
        n = int(np.searchsorted(-lengths, -t))  # the series that have a day t
        expected = level[:n] + phi * slope[:n]
        miss = y[:n, t, None] - expected
        error[:n] += miss * miss
        level[:n] = expected + alpha * miss
        slope[:n] = phi * slope[:n] + gain * miss
    return error, level, slope


def smoothing_ahead(y: np.ndarray, lengths: np.ndarray, horizon: int, grid: np.ndarray) -> np.ndarray:
    """The next values of every series, longest first, by the grid point of the least one-step error."""
    error, level, slope = smooth(y, lengths, grid)
    best = error.argmin(axis=1)
    rows = np.arange(len(y))
    return level[rows, best][:, None] + slope[rows, best][:, None] * np.cumsum(grid[best, 2][:, None] ** np.arange(1, horizon + 1), axis=1)


def smoothing_forecast(values: Sequence[np.ndarray], horizon: int, damped: bool = True, trend: bool = True) -> list[np.ndarray]:
    """Forecasts of many series at once; the mean where there are fewer than three values, NaN where there is none."""
    grid = smoothing_grid(damped, trend)
    out = [np.full(horizon, np.mean(v) if len(v) else np.nan) for v in values]
    lengths = np.array([len(v) for v in values])
    long = np.flatnonzero(lengths >= 3)
    for group in slices(lengths[long], 1 + len(grid)):
        rows = long[group]
        for i, row in zip(rows, smoothing_ahead(*padded([values[r] for r in rows]), horizon, grid)):
            out[i] = row
    return out


def fit_smoothing(daily: DataFrame, keys: Sequence[str], horizon: int = HOLDOUT_DAYS) -> DataFrame:
    """Forecast of the days after each series; NULL for a series without a finite value.

    The recursion runs once for all grid points and all series of an Arrow batch.
    """
    @F.pandas_udf("array<double>")
    def ahead(values: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(f).any() else f for f in smoothing_forecast(list(values), horizon)], dtype=object)

    found = series_arrays(daily, keys).select(*keys, "last_ds", ahead("values").alias("_ahead"))
    steps = found.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*keys, F.date_add("last_ds", F.col("_step")).alias("ds"), F.element_at("_ahead", F.col("_step")).alias("forecast"))


# ---------------------------------------------------------------- autoregression

def fit_autoregression(daily: DataFrame, keys: Sequence[str], horizon: int = HOLDOUT_DAYS) -> DataFrame:
    """One linear model over the scaled lags of all series; the forecast feeds its own values back.

    Scaling uses the given (training) days only. A series with fewer days than lags gets its mean.
    """
    keys = list(keys)
    stats = daily.groupBy(*keys).agg(F.avg("y").alias("_mean"), F.coalesce(F.nullif(F.stddev_pop("y"), F.lit(0.0)), F.lit(1.0)).alias("_std"))
    scaled = daily.join(stats, keys).withColumn("z", (F.col("y") - F.col("_mean")) / F.col("_std"))
    lagged = sequences(scaled.select(*keys, "ds", "z"), keys, y="z")
    lagged = lagged.select(*keys, "z", *[F.col("x")[i].alias(f"x{i}") for i in range(LAGS)])
    assembled = VectorAssembler(inputCols=[f"x{i}" for i in range(LAGS)], outputCol="features").transform(lagged)
    model = LinearRegression(labelCol="z", regParam=0.01, solver="normal").fit(assembled)
    weights, bias = np.array(model.coefficients.toArray()), float(model.intercept)
    schema = ", ".join(f"{k} {daily.schema[k].dataType.simpleString()}" for k in keys) + ", ds date, forecast double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        mean, std = pdf["_mean"].iloc[0], pdf["_std"].iloc[0]
        window = list(pdf["z"].to_numpy()[-LAGS:])
        values = []
        for _ in range(horizon):
            nxt = float(weights @ np.array(window[-LAGS:]) + bias) if len(pdf) > LAGS else 0.0
            window.append(nxt)
            values.append(nxt * std + mean)
        last = pd.Timestamp(pdf["ds"].iloc[-1])
        days = [(last + pd.Timedelta(days=i)).date() for i in range(1, horizon + 1)]
        return pd.DataFrame({"ds": days, "forecast": values}).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "ds", "forecast"]]

    return scaled.groupBy(*keys).applyInPandas(run, schema)


# ---------------------------------------------------------------- search

def search_parameters(daily: DataFrame, keys: Sequence[str], holdout: int = HOLDOUT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(leaderboard of every series, best trial per series) of the search over model families."""
    from .tuning import leaderboard

    results = leaderboard(daily, keys, holdout)
    return results, results.filter("rank = 1")
