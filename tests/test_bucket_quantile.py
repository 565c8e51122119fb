"""Quantiles from bucket counters against plain loops."""

import datetime as dt
import math
import random

import pytest

from millrace.operators import metrics

T0 = dt.datetime(2024, 1, 1)
INF = float("inf")


def expected(rates, q):
    edges = sorted(rates)
    if len(edges) < 2 or edges[-1] != INF:
        return None
    cum, top = [], 0.0
    for e in edges:
        top = max(top, rates[e])
        cum.append(top)
    if cum[-1] <= 0:
        return None
    rank = q * cum[-1]
    i = next(i for i, c in enumerate(cum) if c >= rank)
    if i == len(edges) - 1:
        return edges[-2]
    if i == 0 and edges[0] <= 0:
        return edges[0]
    low, before = (edges[i - 1], cum[i - 1]) if i else (0.0, 0.0)
    return low + (edges[i] - low) * ((rank - before) / (cum[i] - before) if cum[i] > before else 0.0)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantile_of_rates(spark, q):
    rng = random.Random(5)
    groups = {"plain": {0.1: 1.0, 0.5: 3.0, 1.0: 4.0, INF: 4.0}, "falls": {0.1: 3.0, 0.5: 2.0, 1.0: 2.5, INF: 5.0}, "no inf": {0.1: 1.0, 0.5: 2.0},
              "only inf": {INF: 2.0}, "empty": {0.1: 0.0, INF: 0.0}, "beyond": {0.1: 0.0, 0.5: 0.1, INF: 9.0}, "negative": {-1.0: 2.0, 1.0: 3.0, INF: 3.0}}
    groups |= {f"r{i}": {e: rng.random() for e in (0.1, 0.2, 0.9, INF)} for i in range(30)}
    df = spark.createDataFrame([(g, e, r) for g, rates in groups.items() for e, r in rates.items()], "g string, le double, rate double")
    got = {r.g: r.quantile for r in metrics.quantile_of_rates(df, q, ["g"]).collect()}
    for g, rates in groups.items():
        want = expected(rates, q)
        assert got[g] is None if want is None else math.isclose(got[g], want, rel_tol=1e-12), g


def test_rates_over_resets_and_missing_edges(spark):
    """One instance restarts, the other lacks an edge."""
    scrapes = {("a", 1.0): [5, 9, 2, 4], ("a", INF): [6, 12, 3, 8], ("b", INF): [0, 10, 20, 30]}
    rows = [("s", i, le, T0 + dt.timedelta(minutes=5 * k), c, 0) for (i, le), values in scrapes.items() for k, c in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, instance string, le double, ts timestamp_ntz, counter long, seq int")
    got = {(r.step, r.le): r.rate * 900 for r in metrics.bucket_rates(df, 900, 300, ["series"], ["instance"]).collect()}
    last = T0 + dt.timedelta(minutes=15)
    assert got[last, 1.0] == pytest.approx(4 + 2 + 2) and got[last, INF] == pytest.approx((6 + 3 + 5) + 30)
    assert got[T0, INF] == 0


def test_rates_and_increases_over_resets(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(seconds=at), c, i) for s, points in {
        "ok": [(0, 10), (60, 40), (200, 5), (400, 65)], "error": [(0, 1), (100, 31), (500, 31)], "lone": [(30, 7)]}.items()
        for i, (at, c) in enumerate(points)]
    samples = spark.createDataFrame(rows, "series string, ts timestamp_ntz, counter long, seq long")
    got = {r.step: (r.request_rate, r.error_rate) for r in metrics.rate_panels(samples, F.col("series") == "error").collect()}
    # 30 and, after a reset, 5 of the good ones with 30 errors; then 60 and none.
    assert got == {t0: (65 / 300, 30 / 65), t0 + dt.timedelta(seconds=300): (60 / 300, 0.0)}
    as_of = F.lit(t0 + dt.timedelta(seconds=450)).cast("timestamp_ntz")
    assert {r.series: r.increase for r in metrics.latest_increase(samples, as_of, 300).collect()} == {"ok": 65, "error": 0, "lone": 0}
    quiet = samples.filter("series = 'lone'")
    assert [tuple(r)[1:] for r in metrics.rate_panels(quiet, F.col("series") == "error").collect()] == [(0.0, None)]
