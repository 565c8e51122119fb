"""Search over families of forecasting models by successive halving, for many series at once.

A series is one row with its days as arrays. Every rung fits the trials that are still alive on a window of the newest training days and
scores them by MAPE on the days held out; the better half goes on to a window twice as long, the last rung takes the whole history.
Halving need not end with the trial that a full search ranks first: one that needs much history can drop out early.
Spark ranks and halves with array functions, Python fits a family for all series of an Arrow batch by matrix operations. No rung shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecast import HOLDOUT_DAYS, padded, series_arrays, slices, smoothing_ahead, smoothing_grid

#: (family, its parameters) of every trial.
TRIALS = (
    ("mean", {"days": 7}), ("mean", {"days": 28}), ("mean", {"days": 0}),
    ("trend", {"weekly": False}), ("trend", {"weekly": True}),
    ("smoothing", {"trend": False, "damped": False}), ("smoothing", {"trend": True, "damped": False}), ("smoothing", {"trend": True, "damped": True}),
    *(("autoregression", {"lags": p, "ridge": r}) for p in (1, 7, 14) for r in (0.01, 1.0)),
)
LEAST_DAYS = 28  # a window is not shorter, if the series is not
DIGITS = 9  # of a MAPE: equal up to rounding is a tie, which the earlier trial wins


def _mean(y, days, lengths, ahead, last):
    at = np.arange(y.shape[1])
    taken = (at < lengths[:, None]) & (at >= (lengths[:, None] - last if last else 0))
    return np.repeat((y * taken).sum(axis=1, keepdims=True) / taken.sum(axis=1, keepdims=True), ahead.shape[1], axis=1)


def _trend(y, days, lengths, ahead, weekly):
    """A line through the days, times the mean ratio to it of each weekday (1 for a weekday never seen)."""
    there = np.arange(y.shape[1]) < lengths[:, None]
    n, t = lengths[:, None], (days - days[:, :1]) * there
    t_mean, y_mean = t.sum(axis=1, keepdims=True) / n, y.sum(axis=1, keepdims=True) / n
    spread = (((t - t_mean) ** 2) * there).sum(axis=1, keepdims=True)
    slope = ((t - t_mean) * (y - y_mean) * there).sum(axis=1, keepdims=True) / np.where(spread > 0, spread, 1.0)
    line = lambda x: y_mean + slope * (x - t_mean)
    out = line(ahead - days[:, :1])
    if weekly:
        base = line(t)
        usable = there & (base != 0)
        ratio = np.where(usable, y / np.where(usable, base, 1.0), 0.0)
        for weekday in range(7):
            mine = usable & (days % 7 == weekday)
            count = mine.sum(axis=1, keepdims=True)
            index = np.where(count > 0, (ratio * mine).sum(axis=1, keepdims=True) / np.maximum(count, 1), 1.0)
            out = np.where(ahead % 7 == weekday, out * index, out)
    return out


def _smoothing(y, days, lengths, ahead, trend, damped):
    out = np.full(ahead.shape, np.nan)
    n = int((lengths >= 3).sum())  # longest first
    if n:
        out[:n] = smoothing_ahead(y[:n], lengths[:n], ahead.shape[1], smoothing_grid(damped, trend))
    return out


def _autoregression(y, days, lengths, ahead, lags, ridge):
    """Ridge regression on the scaled lags of each series; forecasts feed back. It needs twice as many days as it has weights."""
    out = np.full(ahead.shape, np.nan)
    n = int((lengths >= 2 * (lags + 1)).sum())  # longest first
    if not n:
        return out
    y, size = y[:n], lengths[:n, None]
    there = np.arange(y.shape[1]) < size
    mean = y.sum(axis=1, keepdims=True) / size
    scale = np.sqrt((((y - mean) ** 2) * there).sum(axis=1, keepdims=True) / size)
    scale = np.where(scale > 0, scale, 1.0)
    z = (y - mean) / scale * there
    used = there[:, lags:]
    x = np.stack([*(z[:, lags - 1 - j:z.shape[1] - 1 - j] for j in range(lags)), np.ones(used.shape)], axis=2) * used[:, :, None]
    penalty = np.diag([ridge] * lags + [0.0])
    weights = np.linalg.solve(x.transpose(0, 2, 1) @ x + penalty, (x.transpose(0, 2, 1) @ z[:, lags:, None]))[:, :, 0]
    recent = np.take_along_axis(z, size - 1 - np.arange(lags), axis=1)  # newest first
    for step in range(ahead.shape[1]):
        value = (recent * weights[:, :-1]).sum(axis=1) + weights[:, -1]
        out[:n, step] = value * scale[:, 0] + mean[:, 0]
        recent = np.concatenate([value[:, None], recent[:, :-1]], axis=1)
    return out


FAMILIES = {"mean": lambda *a, days: _mean(*a, last=days), "trend": _trend, "smoothing": _smoothing, "autoregression": _autoregression}
_WIDTH = 64  # numbers a family holds per value of a series, at most


def scores(days: Sequence[np.ndarray], values: Sequence[np.ndarray], windows: Sequence[int], trial: int, holdout: int) -> np.ndarray:
    """MAPE of one trial on the last ``holdout`` days of every series, fitted on the ``windows`` days before. Infinite if there is no
    training day, no day with a value other than 0, too little history for the family, or a forecast that is not finite."""
    family, parameters = TRIALS[trial]
    out = np.full(len(values), np.inf)
    lengths = np.array([min(int(w), len(v) - holdout) for v, w in zip(values, windows)], dtype=int)
    able = np.flatnonzero(lengths > 0)
    for group in slices(lengths[able], _WIDTH):
        rows = able[group]
        train = [(values[r][-holdout - lengths[r]:-holdout], days[r][-holdout - lengths[r]:-holdout]) for r in rows]
        y, size = padded([v for v, _ in train])
        d, _ = padded([x for _, x in train])
        actual, ahead = np.stack([values[r][-holdout:] for r in rows]), np.stack([days[r][-holdout:] for r in rows]).astype(float)
        with np.errstate(all="ignore"):
            miss = np.abs(actual - FAMILIES[family](y, d, size, ahead, **parameters)) / np.abs(actual)
            counted = actual != 0
            mape = np.where(counted, miss, 0.0).sum(axis=1) / counted.sum(axis=1) * 100
        out[rows] = np.where(np.isfinite(mape), np.round(mape, DIGITS), np.inf)
    return out


def _evaluate(holdout: int):
    @F.pandas_udf("array<double>")
    def evaluate(days: pd.Series, values: pd.Series, window: pd.Series, alive: pd.Series) -> pd.Series:
        found = [np.zeros(len(a)) for a in alive]
        for trial in range(len(TRIALS)):
            at = [(i, int(p[0])) for i, a in enumerate(alive) if len(p := np.flatnonzero(np.asarray(a) == trial))]
            got = scores([days.iloc[i] for i, _ in at], [values.iloc[i] for i, _ in at], [window.iloc[i] for i, _ in at], trial, holdout)
            for (i, place), score in zip(at, got):
                found[i][place] = score
        return pd.Series(found, dtype=object)

    return evaluate


def _ended(rung: int):
    """What the board keeps of a trial whose last rung this was."""
    return lambda r: F.struct(F.lit(-rung).alias("out"), r["mape"].alias("mape"), r["trial"].alias("trial"), F.col("_window").alias("days"))


def rungs(trials: int = len(TRIALS)) -> list[int]:
    """Trials alive at each rung."""
    alive = [trials]
    while alive[-1] > 2:
        alive.append(-(-alive[-1] // 2))
    return alive


def leaderboard(daily: DataFrame, keys: Sequence[str], holdout: int = HOLDOUT_DAYS) -> DataFrame:
    """Every trial of every series: the rung it reached, the training days of that rung, its MAPE there, its rank in the series.

    A trial that went further ranks before one that did not; then the lower MAPE, then the earlier trial. A trial that fails counts as
    infinite. Days without a finite value are left out.
    """
    keys, alive_at = list(keys), rungs()
    evaluate = _evaluate(holdout)
    rows = series_arrays(daily, keys).withColumn("_n", F.greatest(F.size("values") - holdout, F.lit(0)))
    rows = rows.withColumn("_alive", F.array(*[F.lit(i) for i in range(len(TRIALS))])).withColumn(
        "_board", F.expr("cast(array() as array<struct<out: int, mape: double, trial: int, days: int>>)"))
    for rung, n in enumerate(alive_at):
        window = F.least("_n", F.greatest(F.lit(LEAST_DAYS), F.ceil(F.col("_n") / 2 ** (len(alive_at) - 1 - rung)))).cast("int")
        rows = rows.withColumn("_window", window).withColumn("_mapes", evaluate("days", "values", "_window", "_alive"))
        rows = rows.withColumn("_ranked", F.array_sort(F.zip_with("_mapes", "_alive", lambda m, t: F.struct(m.alias("mape"), t.alias("trial")))))
        stay = alive_at[rung + 1] if rung + 1 < len(alive_at) else 0
        rows = rows.withColumn("_board", F.concat("_board", F.transform(F.slice("_ranked", stay + 1, n), _ended(rung)))).withColumn(
            "_alive", F.transform(F.slice("_ranked", 1, stay), lambda r: r["trial"]) if stay else F.col("_alive"))
    names = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(", ".join(f"{k}={v}" for k, v in p.items())).alias("parameters")) for f, p in TRIALS])
    board = rows.select(*keys, F.posexplode(F.array_sort("_board")).alias("_at", "_b"))
    name = F.get(names, F.col("_b.trial"))
    return board.select(*keys, F.col("_b.trial").alias("trial"), name["family"].alias("family"), name["parameters"].alias("parameters"),
                        (-F.col("_b.out")).alias("rung"), F.col("_b.days").alias("train_days"), F.col("_b.mape").alias("mape"),
                        (F.col("_at") + 1).alias("rank"))
