"""Metrics of the alert rules and the limits of retraining, on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import drift, metrics, offsets

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_quantile_of_counts_is_the_histogram_quantile(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 4.0), ("a", 50.0), ("b", 999.0), ("c", None)], "k string, v double")
    counted = df.groupBy("k").agg(metrics.cumulative_counts(F.col("v"), metrics.AGENT_BUCKETS).alias("c"))
    got = {r.k: r.q for r in counted.select("k", metrics.quantile_of_counts("c", 0.5, metrics.AGENT_BUCKETS).alias("q")).collect()}
    assert got["a"] == pytest.approx(1 + 4 * 0.5) and got["b"] == 300.0 and got["c"] == 0.0


def test_age_counts_from_the_newest_update(spark):
    rows = [("a", at(0), None), ("a", at(1), at(1.5)), ("a", at(5), None), ("b", at(5), at(5)), ("a", at(6), at(6.25))]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, newest timestamp_ntz")
    got = {(r.series, r.ts): r.age for r in df.withColumn("age", metrics.age_at_step("newest", 3600)).collect()}
    assert got == {("a", at(0)): None, ("a", at(1)): 1800.0, ("a", at(5)): 4.5 * 3600, ("b", at(5)): 3600.0, ("a", at(6)): 2700.0}


def test_partitions_with_too_few_replicas(spark):
    rows = [("t", 0, 0, at(0.1)), ("t", 0, 1, at(0.2)), ("t", 0, 1, at(0.3)), ("t", 1, 0, at(0.4)), ("t", 1, 0, at(1.1)), ("t", 1, 1, at(1.2)), ("u", 0, 0, at(2))]
    df = spark.createDataFrame(rows, "topic string, partition int, replica int, ts timestamp_ntz")
    got = {tuple(r) for r in offsets.under_replicated(df, ["topic"], "partition", "replica", partitions=2, replicas=2).collect()}
    assert got == {("t", at(0), 1), ("t", at(1), 1), ("u", at(2), 2)}


def test_cap_of_a_day_acts_over_all_features(spark):
    rows = [(f, at(h), "retrain") for f in "abc" for h in (0, 6, 23, 24, 30)] + [("d", at(0), "skip"), (None, at(0), "retrain"), ("e", None, "retrain")]
    df = spark.createDataFrame(rows, "feature string, ts timestamp_ntz, action string")
    got = {(r.feature, r.ts): (r.in_cooldown, r.allowed) for r in drift.apply_limits(df, ["feature"], "ts").collect()}
    for day in (0, 24):
        assert [got[f, at(day)] for f in "abc"] == [(False, True), (False, True), (False, False)]
    assert all(got[f, at(h)] == (True, False) for f in "abc" for h in (6, 23, 30))
    assert got["d", at(0)] == (False, False) and not got[None, at(0)][1] and not got["e", None][1]


def test_requests_in_a_cooldown_do_not_prolong_it(spark):
    df = spark.createDataFrame([("a", at(h), "retrain") for h in range(0, 96, 6)], "feature string, ts timestamp_ntz, action string")
    allowed = {r.ts for r in drift.apply_limits(df, ["feature"], "ts").filter("allowed").collect()}
    assert allowed == {at(0), at(24), at(48), at(72)}
    assert drift.apply_limits(df.limit(0), ["feature"], "ts").count() == 0
