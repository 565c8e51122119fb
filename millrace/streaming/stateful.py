"""Windowed, sessionised and per-key stateful stream queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S

# How late a record may be, and the inactivity that ends a session.
WATERMARK = "10 minutes"
SESSION_GAP = "30 minutes"
#: Event time after which the state of an idle key is given up.
IDLE = "7 days"


def read_event_files(spark: SparkSession, folder: str, schema, glob: str = "*", max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files; ``ts`` becomes a zoned timestamp, which watermarks require."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str, slide: str | None = None, by: tuple[str, ...] = (), watermark: str = WATERMARK) -> DataFrame:
    """Counts and exact value sums per event-time window; a window is emitted once the watermark passed its end."""
    return (
        stream.withWatermark("ts", watermark).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), *by)
        .agg(F.count("*").alias("n"), S.stable_sum(F.col("value")).alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")
    )


def sessions(stream: DataFrame, key: str, gap: str = SESSION_GAP, watermark: str = WATERMARK) -> DataFrame:
    return (
        stream.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap))
        .agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def dedupe(stream: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def latest_state(stream: DataFrame, key: str) -> DataFrame:
    """Running state per key by built-in aggregates: newest event, counts, favourite type."""
    return stream.groupBy(key).agg(
        F.max_by("event_id", "ts").alias("last_event"), F.count("*").alias("events"), F.mode("event_type", True).alias("favourite"))


class RecentRows(StatefulProcessor):
    """The newest ``keep`` rows of a key as list state. A timer ends the state of a key that has been idle for ``idle_ms`` of event time."""

    def __init__(self, key: str, keep: int, idle_ms: int):
        self.key, self.keep, self.idle_ms = key, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "micros long, event_id long")

    def _out(self, key: tuple, ids: list[int], first: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(ids), "position": range(first, first + len(ids)), "event_id": ids, "expired": [expired] * len(ids)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            held = sorted([*held, *zip(micros.tolist(), batch["event_id"].tolist())], reverse=True)[: self.keep]
        self.rows.put([(int(m), int(e)) for m, e in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[0][0] // 1000 + self.idle_ms)
        yield self._out(key, [e for _, e in held], 1, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = max((tuple(r) for r in self.rows.get()), default=None)
        self.rows.clear()
        yield self._out(key, [] if last is None else [last[1]], 0, True)

    def close(self) -> None:
        pass


class Breaches(StatefulProcessor):
    """How many windows in a row were above a threshold, per series; the count lives in state, so it goes on over batches and restarts."""

    def __init__(self, threshold: float, minimum: int, step_ms: int):
        self.threshold, self.minimum, self.step_us = threshold, minimum, 1000 * step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "last long, count int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, count = self.state.get() or (None, 0)
        # The windows of one series that were closed in one batch; windows close in the order of time.
        closed = pd.concat(list(rows)).sort_values("ts")
        micros = closed["ts"].astype("datetime64[us]").astype("int64").tolist()
        out = []
        for ts, at, drift in zip(closed["ts"], micros, closed["drift"].tolist()):
            near = last is not None and at - last <= self.step_us
            count = (count if near else 0) + 1 if drift > self.threshold else 0
            last = at
            if count >= self.minimum:
                out.append((key[0], ts, count))
        self.state.update((int(last), int(count)))
        yield pd.DataFrame(out, columns=["series", "ts", "breaches"])

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Processors with timers and lists need this state store. A query keeps the one it started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def recent_rows(stream: DataFrame, key: str, keep: int, idle: str = IDLE, watermark: str = WATERMARK) -> DataFrame:
    """Changes of the newest ``keep`` rows per key: (key, position, event_id, expired).

    A key whose newest row is older than the watermark by ``idle`` gives one row of position 0 with ``expired``, and its state is gone.
    """
    keyed_state(stream.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = stream.schema[key].dataType.simpleString()
    return (stream.select(key, "event_id", "ts").withWatermark("ts", watermark).groupBy(key)
            .transformWithStateInPandas(RecentRows(key, keep, idle_ms), f"{key} {kind}, position int, event_id long, expired boolean", "update", "eventTime"))


def breach_sensor(stream: DataFrame, target: float, threshold: float, minimum: int = 3, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """(series, ts, breaches) as soon as a window closes whose mean value is off its target for the ``minimum``-th time in a row, or longer."""
    keyed_state(stream.sparkSession)
    scores = windowed_counts(stream, width, by=("event_type",), watermark=watermark).select(
        F.col("event_type").alias("series"), F.col("start").alias("ts"), (F.abs(F.col("total") / F.col("n") - target) / 100).alias("drift"))
    step_ms = int(pd.Timedelta(width).total_seconds() * 1000)
    return scores.groupBy("series").transformWithStateInPandas(
        Breaches(threshold, minimum, step_ms), "series string, ts timestamp, breaches int", "append", "none")


def consecutive_breaches(scores: DataFrame, score: Column, threshold: float, minimum: int = 3, step_seconds: int = 3600) -> DataFrame:
    """Windows at which a threshold has been exceeded at least ``minimum`` times in a row."""
    from pyspark.sql import Window

    by_time = Window.partitionBy("series").orderBy("ts")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(by_time), F.col("ts"))
    hit = score > threshold
    marked = scores.withColumn("_hit", hit).withColumn("_break", F.when(hit & (gap <= step_seconds), 0).otherwise(1)).withColumn(
        "_run", F.sum("_break").over(by_time))
    position = F.row_number().over(Window.partitionBy("series", "_run").orderBy("ts"))
    return marked.filter("_hit").withColumn("breaches", position).filter(F.col("breaches") >= minimum).drop("_hit", "_break", "_run")
