"""Smoothing over a grid and the search over model families against plain loops."""

import datetime as dt

import numpy as np
import pytest

from millrace.operators import forecast, tuning

T0 = dt.date(2024, 1, 1)
KEYS = ["series"]


def walk(n, seed, weekly=0.0):
    rng = np.random.default_rng(seed)
    y = 200 + 0.7 * np.arange(n) + rng.normal(0, 4, n).cumsum() * 0.3
    return y * (1 + weekly * (np.arange(n) % 7 == 2))


def frame(spark, series):
    rows = [(name, T0 + dt.timedelta(days=i), None if v is None else float(v)) for name, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series string, ds date, y double").repartition(3)


def loop_smoothing(y, horizon, damped=True, trend=True):
    best = None
    for a, b, p in forecast.smoothing_grid(damped, trend):
        level, slope, error = y[0], y[1] - y[0], 0.0
        for value in y[1:]:
            expected = level + p * slope
            miss = value - expected
            error += miss * miss
            level, slope = expected + a * miss, p * slope + a * b * miss
        if best is None or error < best[0]:
            best = error, level, slope, p
    _, level, slope, p = best
    return np.array([level + slope * sum(p ** k for k in range(1, h + 1)) for h in range(1, horizon + 1)])


def loop_forecast(family, parameters, y, days, ahead):
    if family == "mean":
        return np.full(len(ahead), np.mean(y[-parameters["days"]:]))
    if family == "trend":
        t = days - days[0]
        slope, start = np.polyfit(t, y, 1) if len(y) > 1 else (0.0, y[0])
        index = {w: np.mean([v / (start + slope * x) for v, x, d in zip(y, t, days) if d % 7 == w]) for w in set(days % 7)}
        return np.array([(start + slope * (d - days[0])) * (index.get(d % 7, 1.0) if parameters["weekly"] else 1.0) for d in ahead])
    if family == "smoothing":
        return loop_smoothing(y, len(ahead), parameters["damped"], parameters["trend"]) if len(y) >= 3 else np.full(len(ahead), np.nan)
    p = parameters["lags"]
    if len(y) < 2 * (p + 1):
        return np.full(len(ahead), np.nan)
    mean, scale = y.mean(), y.std() or 1.0
    z = list((y - mean) / scale)
    x = np.array([[*z[t - p:t][::-1], 1.0] for t in range(p, len(z))])
    w = np.linalg.solve(x.T @ x + np.diag([parameters["ridge"]] * p + [0.0]), x.T @ np.array(z[p:]))
    for _ in ahead:
        z.append(float(np.dot(w[:-1], z[-p:][::-1]) + w[-1]))
    return np.array(z[-len(ahead):]) * scale + mean


def loop_score(trial, y, days, window, holdout=7):
    train, actual = y[:-holdout][-window:], y[-holdout:]
    if len(y) <= holdout or not (actual != 0).any():
        return np.inf
    out = loop_forecast(*tuning.TRIALS[trial], train, days[:-holdout][-window:], days[-holdout:])
    used = actual != 0
    mape = np.mean(np.abs((actual - out)[used] / actual[used])) * 100
    return mape if np.isfinite(mape) else np.inf


def test_smoothing_equals_the_loop():
    series = [walk(n, n) for n in (3, 4, 90, 17, 400, 90)]
    for damped, trend in ((True, True), (False, True), (False, False)):
        for y, got in zip(series, forecast.smoothing_forecast(series, 5, damped, trend)):
            assert got == pytest.approx(loop_smoothing(y, 5, damped, trend), rel=1e-9)


def test_small_matrices_give_the_same(monkeypatch):
    series = [walk(n, n) for n in (3, 40, 17, 2, 0, 60)]
    whole = forecast.smoothing_forecast(series, 4)
    monkeypatch.setattr(forecast, "MAX_CELLS", 100)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(whole, forecast.smoothing_forecast(series, 4)))


def test_smoothing_of_odd_series(spark):
    rows = frame(spark, {"two": [1, 3], "none": [None, float("nan")], "gap": [5, None, 5, 5, float("inf")], "one": [4]})
    got = {(r.series, r.ds): r.forecast for r in forecast.fit_smoothing(rows, KEYS, 1).collect()}
    day = lambda i: T0 + dt.timedelta(days=i)
    assert got == {("two", day(2)): 2.0, ("none", day(2)): None, ("gap", day(5)): 5.0, ("one", day(1)): 4.0}


@pytest.mark.parametrize("trial", range(len(tuning.TRIALS)))
def test_families_equal_plain_loops(trial):
    series = [walk(n, n, 0.2) for n in (8, 9, 20, 37, 60, 150)] + [np.zeros(30), np.full(30, 7.0), np.arange(40.0) - 20]
    rng = np.random.default_rng(3)
    days = [np.sort(rng.choice(np.arange(19000, 19000 + 2 * len(y)), len(y), replace=False)) for y in series]
    for window in (1, 12, 28, 1000):
        got = tuning.scores(days, series, [window] * len(series), trial, 7)
        want = [loop_score(trial, y, d, window) for y, d in zip(series, days)]
        if tuning.TRIALS[trial][0] == "trend" and window == 1000:
            got, want = np.delete(got, [6, 8]), np.delete(want, [6, 8])  # ratios to a line through zero
        assert got == pytest.approx(want, rel=1e-6, abs=1e-7)


def halving(y, days):
    """The search written out for one series: (trial, rung, mape) in the order of ranks."""
    alive, board, counts = list(range(len(tuning.TRIALS))), [], tuning.rungs()
    n = max(0, len(y) - 7)
    for rung in range(len(counts)):
        window = min(n, max(tuning.LEAST_DAYS, -(-n // 2 ** (len(counts) - 1 - rung))))
        ranked = sorted((round(loop_score(t, y, days, window), tuning.DIGITS), t) for t in alive)
        keep = counts[rung + 1] if rung + 1 < len(counts) else 0
        board = [(t, rung, m) for m, t in ranked[keep:]] + board
        alive = [t for _, t in ranked[:keep]]
    return sorted(board, key=lambda b: (-b[1], b[2], b[0]))


def test_leaderboard_equals_the_search_written_out(spark):
    series = {f"s{i}": walk(n, i, w) for i, (n, w) in enumerate([(300, 0.5), (300, 0.0), (120, 0.3), (50, 0.0), (20, 0.2), (9, 0.0)])}
    got = tuning.leaderboard(frame(spark, series), KEYS).collect()
    first = (T0 - dt.date(1970, 1, 1)).days
    for name, y in series.items():
        mine = sorted((r for r in got if r.series == name), key=lambda r: r["rank"])
        want = halving(y, first + np.arange(len(y)))
        assert [r["rank"] for r in mine] == list(range(1, len(tuning.TRIALS) + 1))
        assert [(r.trial, r.rung) for r in mine] == [(t, g) for t, g, _ in want]
        assert [r.mape for r in mine] == pytest.approx([m for *_, m in want], rel=1e-6, abs=1e-7)


def test_winner_against_the_full_search(spark):
    """A model that is exact at every length wins as in the full search; the winner's error is always that of its fit on the whole history."""
    days = (T0 - dt.date(1970, 1, 1)).days + np.arange(200)
    series = {"line": 50 + 3.0 * np.arange(200), "weekly": (100 + 2.0 * np.arange(200)) * (1 + 0.5 * (days % 7 == 2)), "short": walk(30, 4)}
    best = {r.series: r for r in tuning.leaderboard(frame(spark, series), KEYS).filter("rank = 1").collect()}
    for name, y in series.items():
        full = [loop_score(t, y, days[:len(y)], len(y)) for t in range(len(tuning.TRIALS))]
        assert best[name].mape == pytest.approx(full[best[name].trial], abs=1e-6) and best[name].train_days == len(y) - 7
        assert name == "weekly" or best[name].mape == pytest.approx(min(full), abs=1e-6)  # there halving ends with a near second
    assert best["line"].family == "trend"


def test_odd_series_have_a_board(spark):
    got = tuning.leaderboard(frame(spark, {"short": [1.0, 2.0], "none": [None], "zero": [0.0] * 20}), KEYS).collect()
    assert len(got) == 3 * len(tuning.TRIALS) and all(r.mape == float("inf") for r in got)
    assert tuning.leaderboard(frame(spark, {"a": [1.0]}).limit(0), KEYS).count() == 0
