"""Stream sources and sinks: file topics, idempotent dual sink, recent-rows feed.

A topic is a folder of JSON files with the broker columns; with a broker connector on the class path the same records come
from ``read_stream``. Sinks are keyed by ``batch_id``: a replayed batch overwrites its own output, so both sinks hold each
record once.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import geo

# The ingest job's trigger and per-trigger cap.
TRIGGER = "10 seconds"
MAX_OFFSETS_PER_TRIGGER = 10000

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_topic(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(E.ENVELOPE_SCHEMA).option("timestampFormat", MICROS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def read_stream(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    """The source a configuration names: a folder of record files, or a broker topic if its connector is on the class path.

    ``settings`` holds ``path`` (and ``maxFilesPerTrigger``), or the connector's own options, which are passed on as they are.
    """
    if "path" in settings:
        return read_topic(spark, settings["path"], int(settings["maxFilesPerTrigger"]) if "maxFilesPerTrigger" in settings else None)
    return spark.readStream.format("kafka").options(**{"maxOffsetsPerTrigger": str(MAX_OFFSETS_PER_TRIGGER), **settings}).load()


def publish(messages: DataFrame, path: str, files: int | None = None, key: str = "key", limit: int | None = None) -> None:
    """Keyed messages to a file topic; one key stays in one file, in the order of the input."""
    if limit is not None:
        messages = messages.limit(limit)
    if files:
        messages = messages.repartition(files, key)
    messages.write.mode("append").option("timestampFormat", MICROS).json(path)


def drain(writer, checkpoint: str, name: str | None = None) -> None:
    """Process everything available, then stop. Offsets and commits live in ``checkpoint``.

    A stateful query keeps one state store per shuffle partition, as configured when it first runs on ``checkpoint``.
    """
    query = run(writer, checkpoint, name, trigger=None)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run(writer, checkpoint: str, name: str | None = None, trigger: str | None = TRIGGER):
    """Start a stream and return its query: a micro-batch every ``trigger``, or all that is available without one.

    The record cap per trigger belongs to the source: ``read_stream`` caps files or offsets.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def run_to_end(writer, checkpoint: str, name: str | None = None, trigger: str = "0 seconds"):
    """Run triggers until a source that caps its own records has no more, stop, and return the ended query."""
    query = run(writer, checkpoint, name, trigger)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


# What ``normalize`` leaves as it came: records that are equal in these are equal before and after it.
_KEPT_AS_SENT = {"id", "timestamp", "event_timestamp", "price", "quantity", "location", "metadata",
                 "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp"}


def ingest(records: DataFrame, watermark: str | None = None, dedupe: Sequence[str] = ()) -> DataFrame:
    """decode -> validate -> normalise -> region, all on the stream itself, so watermark and dedup apply.

    Copies go before the records are normalised, if the keys allow it: fewer and narrower rows are shuffled, and each is normalised once.
    """
    out = E.with_time(E.drop_malformed(E.decode_envelope(records)))
    early = set(dedupe) <= _KEPT_AS_SENT
    if watermark:
        out = out.withWatermark("event_timestamp", watermark)
        if dedupe and early:
            out = out.dropDuplicatesWithinWatermark(list(dedupe))
    out = geo.enrich_region(E.normalize(out, timed=True))
    return out.dropDuplicatesWithinWatermark(list(dedupe)) if watermark and dedupe and not early else out


@contextmanager
def _adaptive(spark: SparkSession):
    """Adaptive execution for what is written of a micro-batch. A stream runs without it, and then ``rebalance`` is ignored.

    The stream's own plan is made before its batch gets here, so its state stays in its partitions.
    """
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def write_batch(batch: DataFrame, batch_id: int, table_path: str, topic_path: str) -> None:
    """Both sinks of one micro-batch, computed once. Replaying the batch replaces what it wrote before."""
    rows = batch.select(*E.STREAM_COLUMNS, "timestamp", "metadata").persist()
    try:
        with _adaptive(batch.sparkSession):
            # One shuffle of the micro-batch by day instead of a small file per task and day.
            (rows.select(*E.STREAM_COLUMNS, F.lit(batch_id).alias("batch_id")).hint("rebalance", "dt").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(table_path))
            E.canonical_messages(rows).write.mode("overwrite").json(f"{topic_path}/batch_id={batch_id}")
    finally:
        rows.unpersist()


def run_dual_sink(stream: DataFrame, table_path: str, topic_path: str, checkpoint: str) -> None:
    writer = stream.writeStream.foreachBatch(lambda df, i: write_batch(df, i, table_path, topic_path))
    drain(writer, checkpoint, "dual_sink")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string, batch_id int").json(path)


def run_split_sink(records: DataFrame, table_path: str, dead_letter_path: str, checkpoint: str) -> None:
    """Valid records to the table, the others with their violations to the dead-letter topic."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = E.with_validity(batch).persist()
        try:
            good = geo.enrich_region(E.normalize(checked.filter("is_valid").drop("errors", "is_valid")))
            good.select(*E.STREAM_COLUMNS).write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
            checked.filter("NOT is_valid").select("id", "kafka_partition", "kafka_offset", "errors").write.mode("overwrite").json(
                f"{dead_letter_path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    drain(E.decode_envelope(records).writeStream.foreachBatch(write), checkpoint, "dead_letter")


def run_recent_feed(stream: DataFrame, path: str, checkpoint: str, order: Sequence[str], keep: int = 1000) -> None:
    """The newest ``keep`` rows over all batches, one folder per batch; the newest folder is the feed."""
    columns = stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{path}/batch_id={batch_id - 1}"))
        newest = rows.select(*columns).orderBy(*[F.desc(c) for c in order]).limit(keep)
        newest.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    drain(stream.writeStream.foreachBatch(write), checkpoint, "recent_feed")


def read_latest_batch(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("int"))
    return stored.filter(F.col("batch_id") == stored.agg(F.max("batch_id")).scalar()).drop("batch_id")
