"""Order statistics and as-of joins against brute force, with hot groups that are cut into slices."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import drift, evaluate, ordered
from millrace.operators.asof import asof_join


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", float(rng.choice([rng.randrange(50), rng.random() * 1000]))) for _ in range(n)]


@pytest.mark.parametrize("hot_weight", [0, 100, 10**9])
def test_running_totals_do_not_depend_on_the_cuts(spark, hot_weight):
    pdf = pd.DataFrame(skewed(), columns=["k", "v"]).groupby(["k", "v"]).size().rename("n").reset_index()
    got = ordered.running_totals(spark.createDataFrame(pdf), "v", ["n"], ["k"], splits=9, hot_weight=hot_weight).toPandas()
    pdf["cum_n"] = pdf.sort_values("v").groupby("k")["n"].cumsum()
    pdf["total_n"] = pdf.groupby("k")["n"].transform("sum")
    key = ["k", "v"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True)[pdf.columns], pdf.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_hot_groups_are_really_cut(spark):
    df = spark.createDataFrame(pd.DataFrame(skewed(), columns=["k", "v"])).groupBy("k", "v").agg(F.count("*").alias("n"))
    plan = ordered.running_totals(df, "v", ["n"], ["k"], splits=9, hot_weight=100)
    assert "_slice" in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_equal_numpy(spark, keys, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_GROUP_WEIGHT", 50)
    pdf = pd.DataFrame(skewed(), columns=["k", "v"])
    got = ordered.quantiles(spark.createDataFrame(pdf), "v", {"a": 0.35, "b": 0.5, "c": 1.0}, keys).toPandas()
    for _, row in got.iterrows():
        values = pdf[pdf.k == row.k].v if keys else pdf.v
        np.testing.assert_allclose([row.a, row.b, row.c], np.quantile(values, [0.35, 0.5, 1.0]))


def test_index_percentiles(spark):
    values = sorted(v for _, v in skewed(500))
    got = ordered.index_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    assert (got.p50, got.p95, got.p100) == (values[250], values[int(500 * 0.95)], values[-1])


def test_modal_value_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "k int, v string")
    assert {r.k: r.v for r in ordered.modal_value(df, ["k"], "v").collect()} == {1: "a", 2: "c"}


@pytest.mark.parametrize("slice_seconds, hot_rows", [(60, None), (3600, 5), (10**7, None), (10**7, 40)])
def test_previous_row_crosses_slices(spark, slice_seconds, hot_rows):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else "cold", start + dt.timedelta(seconds=rng.randrange(200000)), i) for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["k", "ts", "x"])
    got = ordered.previous_row(spark.createDataFrame(pdf), ["k"], ["ts", "x"], ["x"], "ts", slice_seconds, hot_rows).toPandas()
    pdf = pdf.sort_values(["ts", "x"])
    pdf["prev_x"] = pdf.groupby("k")["x"].shift()
    left = got.set_index("x")["prev_x"].sort_index()
    pd.testing.assert_series_equal(left, pdf.set_index("x")["prev_x"].sort_index(), check_dtype=False)


@pytest.mark.parametrize("slice_seconds, hot_rows", [(60, None), (3600, 4), (10**7, None), (10**7, 30)])
@pytest.mark.parametrize("ttl", [None, 7200])
def test_asof_join_equals_brute_force(spark, slice_seconds, hot_rows, ttl):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rng.randrange(0, 100000, 50))
    who = lambda: "hot" if rng.random() < 0.5 else f"u{rng.randrange(5)}"
    features = [(who(), at(), at(), i) for i in range(150)]
    requests = [(who() if i % 17 else None, at(), i) for i in range(200)]
    got = asof_join(
        spark.createDataFrame(requests, "u string, t timestamp_ntz, rid int"),
        spark.createDataFrame(features, "u string, ft timestamp_ntz, created timestamp_ntz, fid int"),
        ["u"], "t", "ft", ["fid"], created="created", ttl_seconds=ttl, slice_seconds=slice_seconds, hot_rows=hot_rows).collect()
    assert len(got) == len(requests)
    for row in got:
        known = [f for f in features if f[0] == row.u and f[1] <= row.t]
        best = max(known, key=lambda f: (f[1], f[2])) if known else None
        if best and ttl is not None and (row.t - best[1]).total_seconds() > ttl:
            best = None
        assert (best is None) == (row.fid is None)
        if best:
            assert row.matched_ts == best[1]
            assert row.fid in [f[3] for f in known if (f[1], f[2]) == (best[1], best[2])]


def test_a_burst_inside_one_slice_is_spread(spark):
    """One entity holds most rows, all within a few minutes of one hour."""
    burst = spark.range(20_000).select(F.lit("hot").alias("k"), (F.lit(1_704_067_200_000_000) + F.col("id") * 10_007).alias("us"))
    rows = burst.unionByName(spark.range(500).select(F.concat(F.lit("u"), (F.col("id") % 9).cast("string")).alias("k"), (F.lit(1_704_067_200_000_000) + F.col("id") * 10**7).alias("us")))
    rows = rows.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    cuts = ordered.hot_cuts(rows, ["k"], "ts", 3600, 1000)
    sizes = ordered.with_time_slice(rows, cuts, ["k"], "ts", 3600).groupBy("k", "_slice").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    assert max(r.n for r in sizes) < 700 and sum(r.n for r in sizes) == 20_500
    hot = sorted((r._slice, r.a, r.b) for r in sizes if r.k == "hot")
    assert len(hot) > 32 and all(x[2] < y[1] for x, y in zip(hot, hot[1:]))


def auc_by_pairs(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), float(rng.randrange(8))) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(auc_by_pairs(rows))
    one_class = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert evaluate.roc_auc(one_class).first()["auc"] is None


def test_errors_of_a_perfect_and_a_zero_series(spark):
    perfect = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert tuple(evaluate.forecast_errors(perfect, "y", "p").first()) == (0.0, 0.0)
    zeros = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert tuple(evaluate.forecast_errors(zeros, "y", "p").first()) == (float("inf"), 1.0)


def test_fairness_extremes(spark):
    rows = [("A", 1, 1)] * 5 + [("B", 1, 0)] * 5
    df = spark.createDataFrame(rows, "segment string, label int, prediction int")
    _, verdict = evaluate.demographic_parity(df)
    assert tuple(verdict.first()) == (0.0, False)
    _, odds = evaluate.equalized_odds(df)
    assert odds.first()["tpr_gap"] == 1.0
    assert evaluate.binary_metrics(df.filter("segment = 'B'")).first()["precision"] == 0.0


def test_drift_is_zero_without_a_change(spark):
    df = spark.createDataFrame([(float(i % 97),) for i in range(2000)], "v double")
    assert drift.psi(df, df, "v").first()["psi"] == pytest.approx(0.0)
    moved = df.withColumn("v", F.col("v") + 60)
    assert drift.psi(df, moved, "v").first()["psi"] > drift.DRIFT_CRITICAL


def test_missing_metric_does_not_pass_a_gate(spark):
    df = spark.createDataFrame([(None, 10.0), (float("nan"), 10.0), (0.9, 10.0)], "a double, m double").withColumn(
        "a", F.nanvl("a", F.lit(None).cast("double")))
    assert [r.passed for r in drift.metric_gates(df, "a", "m").collect()] == [False, False, True]


def test_no_row_is_dropped_unseen(spark):
    """A missing label is no label, any other than 0 and 1 stops the job."""
    rows = spark.createDataFrame([(1, 0.9), (0, 0.4), (None, 0.5)], "label int, score double")
    assert evaluate.roc_auc(rows).first()["auc"] == 1.0
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        evaluate.roc_auc(rows.unionByName(spark.createDataFrame([(2, 0.7)], "label int, score double"))).collect()
    with pytest.raises(Exception, match="negative measure"):
        ordered.running_totals(spark.createDataFrame([(1.0, -1)], "v double, n long"), "v", ["n"]).collect()


def test_small_and_large_values_keep_their_digits(spark):
    from millrace.functions import scalars as S

    small = spark.createDataFrame([(1e-5,), (3e-5,)], "v double").agg(S.stable_sum(F.col("v")).alias("s"), S.stable_avg(F.col("v")).alias("m")).first()
    assert (small.s, small.m) == (4e-5, 2e-5)
    large = spark.createDataFrame([(2.0e10,), (1e10,)], "v double").agg(S.stable_sum(F.col("v")).alias("s")).first()
    assert large.s == 3e10


def test_tied_times_lose_no_row_between_pages(spark):
    from millrace.plans.ordering import keyset_page

    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, 0, i // 40)) for i in range(200)], "event_id long, ts timestamp_ntz")
    seen, last = [], (F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz"), F.lit(10**9))
    while page := keyset_page(rows, *last, 50).collect():
        seen += [r.event_id for r in page]
        last = (F.lit(page[-1].ts), F.lit(page[-1].event_id))
    assert seen == list(range(199, -1, -1))


def test_an_alert_that_comes_back_is_sent_again(spark):
    from millrace.operators import alerts

    times = [0, 3600, 7200, 14400 + 3600, 14400 + 7200]
    rows = [("A", "j", "warning", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for t in times]
    sent = alerts.notifications(spark.createDataFrame(rows, "alertname string, job string, severity string, ts timestamp")).orderBy("sent_at").collect()
    assert [(r.sent_at - dt.datetime(2024, 1, 1)).total_seconds() for r in sent] == [0.0, 18000.0]
