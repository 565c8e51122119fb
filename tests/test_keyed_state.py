"""Keyed stream state: counts that outlive a restart, buffers that a timer ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import sinks, stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"


@pytest.fixture
def provider(spark):
    """Other tests keep the state store they had."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def run(spark, stream, mode, out, checkpoint):
    batches = []

    def keep(df, i):
        batches.append([tuple(r) for r in df.collect()])

    sinks.drain(stream.writeStream.outputMode(mode).foreachBatch(keep), checkpoint)
    return [r for b in batches for r in b]


def test_breaches_in_a_row_are_counted_over_restarts(spark, tmp_path, provider):
    rng = random.Random(3)
    rows = []
    for kind in ("a", "b"):
        for hour in range(60):
            if rng.random() < 0.1:
                continue  # a missing window breaks the run
            level = 80.0 if rng.random() < 0.7 else 50.0
            rows += [(len(rows), 1, kind, level, T0 + dt.timedelta(hours=hour, minutes=m)) for m in (5, 35)]
    rows.sort(key=lambda r: r[4])
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    got = []
    for at in range(0, len(rows), 37):  # the query ends after each part and starts again
        spark.createDataFrame(rows[at : at + 37], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = stateful.breach_sensor(stateful.read_event_files(spark, folder, spark.createDataFrame([], SCHEMA).schema), 50, 0.1)
        new = run(spark, stream, "append", None, checkpoint)
        got += new
    hourly = (spark.createDataFrame(rows, SCHEMA).groupBy(F.col("event_type").alias("series"), F.window("ts", "1 hour").start.alias("ts"))
              .agg((F.abs(F.avg("value") - 50) / 100).alias("drift")))
    closed = max(r[4] for r in rows) - dt.timedelta(minutes=10)
    want = [(r.series, r.ts, r.breaches) for r in stateful.consecutive_breaches(hourly, F.col("drift"), 0.1).collect() if r.ts + dt.timedelta(hours=1) <= closed]
    assert sorted((s, t.replace(tzinfo=None), n) for s, t, n in got) == sorted(want) and any(n > 3 for *_, n in want)


def test_idle_keys_lose_their_buffer(spark, tmp_path, provider):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    at = lambda h: T0 + dt.timedelta(hours=h)
    parts = [[(i, 1, "a", 0.0, at(i / 10)) for i in range(8)] + [(100, 2, "a", 0.0, at(0))],
             [(200, 3, "a", 0.0, at(30))],  # the watermark passes: 1 and 2 have been idle
             [(300, 1, "a", 0.0, at(31)), (301, 3, "a", 0.0, at(31))]]
    seen = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = stateful.read_event_files(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        seen.append(sorted(run(spark, stateful.recent_rows(stream, "user_id", 3, "10 hours"), "update", None, checkpoint)))
    assert seen[0] == [(1, 1, 7, False), (1, 2, 6, False), (1, 3, 5, False), (2, 1, 100, False)]
    assert seen[1] == [(1, 0, 7, True), (2, 0, 100, True), (3, 1, 200, False)]
    assert seen[2] == [(1, 1, 300, False), (3, 1, 301, False), (3, 2, 200, False)]
