"""Streaming (R, X5). Each stream drains the available input, stops, and its stored result is compared with batch SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import geo
from ..operators.ordered import top_per_group
from ..session import scratch_dir
from ..sources import lake
from ..streaming import log_source, sinks, stateful
from .catalog import query
from .features_sql import esum
from .scans import NORMALIZED_SQL
from .tables import ENVELOPE_SQL, envelope, events, table

_NTZ = "timestamp_ntz"


def event_stream(spark, sf):
    return stateful.read_event_files(spark, sf, events(spark, sf).schema, "events.parquet")


def drained(spark, stream, name, mode="append"):
    """Run a stream into a table folder and read it back, with plain timestamps."""
    out = scratch_dir(spark, name)
    sinks.drain(stream.writeStream.format("parquet").outputMode(mode).option("path", out), scratch_dir(spark, f"{name}-offsets"))
    stored = spark.read.schema(stream.schema).parquet(out)
    return stored.withColumns({c: F.col(c).cast(_NTZ) for c, t in stored.dtypes if t == "timestamp"})


def publish_spread(spark, records, topic):
    """Keyed messages in as many files as the cluster has partitions for a shuffle, several at least."""
    sinks.publish(records, topic, files=max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("r1_hourly_windows", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, {esum('value')} AS total
FROM events GROUP BY 1, 2, 3 HAVING "end" <= {_CLOSED}""")
def r1_hourly_windows(spark, sf):
    return drained(spark, stateful.windowed_counts(event_stream(spark, sf), "1 hour", by=("event_type",)), "hourly")


@query("r1_sliding_windows", f"""WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS start, value FROM events)
SELECT start, start + INTERVAL 5 MINUTE AS "end", count(*) AS n, {esum('value')} AS total FROM w GROUP BY 1 HAVING "end" <= {_CLOSED}""")
def r1_sliding_windows(spark, sf):
    return drained(spark, stateful.windowed_counts(event_stream(spark, sf), "5 minutes", "1 minute"), "sliding")


@query("r2_sessions_by_gap", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid HAVING "end" <= {_CLOSED}""")
def r2_sessions_by_gap(spark, sf):
    return drained(spark, stateful.sessions(event_stream(spark, sf), "user_id"), "sessions")


@query("r2_sessions_by_id", f"""WITH lines AS (SELECT l_orderkey, l_extendedprice * CAST(l_quantity AS INTEGER) AS amount FROM lineitem)
SELECT 's' || l_orderkey AS session_id, count(*) AS n, {esum('amount')} AS total FROM lines GROUP BY 1""")
def r2_sessions_by_id(spark, sf):
    amount = F.col("l_extendedprice") * F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), "l_orderkey").alias("session_id")).agg(
        F.count("*").alias("n"), S.stable_sum(amount).alias("total"))


@query("r3_late_records", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", count(*) AS n, {esum('value')} AS total
FROM events GROUP BY 1, 2 HAVING "end" <= {_CLOSED}""")
def r3_late_records(spark, sf):
    """The same events arrive a second time, behind the watermark, and change no closed window."""
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("late", "late-windows", "late-offsets"))
    for _ in range(2):
        events(spark, sf).write.mode("append").parquet(folder)
        counts = stateful.windowed_counts(stateful.read_event_files(spark, folder, events(spark, sf).schema, "*.parquet"), "1 hour")
        sinks.drain(counts.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)
    return spark.read.parquet(out).withColumns({c: F.col(c).cast(_NTZ) for c in ("start", "end")})


@query("r4_stream_dedupe", "SELECT event_id, user_id, value FROM events")
def r4_stream_dedupe(spark, sf):
    folder = scratch_dir(spark, "twice")
    twice = events(spark, sf).unionByName(events(spark, sf))
    twice.write.parquet(folder)
    stream = stateful.read_event_files(spark, folder, events(spark, sf).schema, "*.parquet")
    return drained(spark, stateful.dedupe(stream, ["event_id"]), "deduped").select("event_id", "user_id", "value")


@query("r5_capped_batches", "SELECT count(*) AS records, true AS within_cap, true AS several_batches FROM events")
def r5_capped_batches(spark, sf):
    """Each trigger takes at most two files."""
    topic, out = scratch_dir(spark, "topic"), scratch_dir(spark, "counts")
    publish_spread(spark, envelope(spark, sf), topic)
    stream = sinks.read_topic(spark, topic, 2).withColumn("file", F.input_file_name())

    def count(batch, batch_id):
        batch.agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    sinks.drain(stream.writeStream.foreachBatch(count), scratch_dir(spark, "offsets"), "capped_batches")
    return spark.read.parquet(out).agg(F.sum("n").alias("records"), (F.max("files") <= 2).alias("within_cap"), (F.count("*") > 1).alias("several_batches"))


@query("r5_record_cap", """SELECT count(*) AS records, greatest(1, count(*) // 4) AS largest_batch, ceil(count(*) / greatest(1, count(*) // 4))::BIGINT AS batches FROM events""")
def r5_record_cap(spark, sf):
    """A trigger takes a quarter of the records at most; the query is stopped after its first trigger and taken up again."""
    records = envelope(spark, sf)
    log, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "counts", "offsets"))
    cap = max(1, records.count() // 4)
    log_source.publish_log(records, log)

    def count(batch, batch_id):
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if batch_id == 0 and not stopped:
            stopped.append(True)
            raise InterruptedError("stopped on purpose after the first batch was written")

    stopped: list[bool] = []
    for _ in range(2):
        stream = log_source.read_log(spark, log, checkpoint, maxOffsetsPerTrigger=cap)
        try:
            sinks.run_to_end(stream.writeStream.foreachBatch(count), checkpoint, "record_cap")
        except StreamingQueryException as e:
            if "on purpose" not in str(e):
                raise
    counts = spark.read.parquet(out).filter("n > 0")
    return counts.agg(F.sum("n").alias("records"), F.max("n").alias("largest_batch"), F.count("*").alias("batches"))


@query("r5_trigger_interval", "SELECT count(*) AS records, true AS on_the_interval, 2 AS batches FROM events")
def r5_trigger_interval(spark, sf):
    """A named query with a trigger every ten seconds; half of the records a trigger."""
    records = envelope(spark, sf)
    log, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "read", "offsets"))
    log_source.publish_log(records, log)
    stream = log_source.read_log(spark, log, checkpoint, maxOffsetsPerTrigger=max(1, -(-records.count() // 2)))
    ended = sinks.run_to_end(stream.writeStream.format("parquet").option("path", out), checkpoint, "ten_seconds", sinks.TRIGGER)
    full = [p for p in ended.recentProgress if p.numInputRows > 0]
    starts = [p.timestamp for p in full]
    # After the first, a trigger starts on a multiple of the interval.
    late = [float(t[17:23]) % 10 for t in starts[1:]]
    row = (spark.read.parquet(out).count(), all(x < 3 for x in late), len(full))
    return spark.createDataFrame([row], "records long, on_the_interval boolean, batches int")


@query("r6_resume", f"WITH {ENVELOPE_SQL} SELECT id, price FROM env")
def r6_resume(spark, sf):
    """A second run on the same checkpoint reads only what arrived since; nothing is lost or doubled."""
    topic, out, checkpoint = (scratch_dir(spark, n) for n in ("topic", "resumed", "offsets"))
    records, half = envelope(spark, sf), F.expr("TIMESTAMP '2024-01-15'")
    for part in (records.filter(F.col("timestamp") < half), records.filter(F.col("timestamp") >= half)):
        publish_spread(spark, part, topic)
        stream = E.decode_envelope(sinks.read_topic(spark, topic)).select("id", "price")
        sinks.drain(stream.writeStream.format("parquet").option("path", out), checkpoint)
    return spark.read.parquet(out)


@query("r7_ingest_stream", f"WITH {NORMALIZED_SQL} SELECT id, dt, user_id, product_id, price, quantity, total_amount, city, country, region, channel FROM good")
def r7_ingest_stream(spark, sf):
    topic, out, mirror = (scratch_dir(spark, n) for n in ("topic", "table", "mirror"))
    # Every record twice: the dedup state removes the copy. Without a cap all files are one batch.
    records = envelope(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    sinks.publish(records, topic)
    sinks.run_dual_sink(sinks.ingest(sinks.read_topic(spark, topic), stateful.WATERMARK, ["id"]), out, mirror, scratch_dir(spark, "offsets"))
    return lake.read_table(spark, out).select(
        "id", "dt", "user_id", "product_id", "price", "quantity", "total_amount", "city", "country", "region", "channel")


@query("r8_stream_enrichment", """SELECT event_id, c_mktsegment AS segment, n_name AS nation FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def r8_stream_enrichment(spark, sf):
    """Stream joined with static dimensions; Catalyst broadcasts them when their measured size allows."""
    profile = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    return drained(spark, event_stream(spark, sf).join(profile, "user_id", "left").select("event_id", "segment", "nation"), "enriched")


def _upserted(spark, stream, keys, name):
    """Update-mode output stored per batch; the newest version of a key is its state."""
    out = scratch_dir(spark, name)
    sinks.drain(stream.writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}")), scratch_dir(spark, f"{name}-offsets"), name)
    return top_per_group(spark.read.parquet(out), keys, [F.desc(F.col("batch_id").cast("int"))], 1).drop("batch_id")


@query("r9_user_state", """WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_id, ts) AS last_event, count(*) AS events, (SELECT event_type FROM f WHERE f.user_id = e.user_id ORDER BY n DESC, event_type LIMIT 1) AS favourite FROM events e GROUP BY 1""")
def r9_user_state(spark, sf):
    return _upserted(spark, stateful.latest_state(event_stream(spark, sf), "user_id"), ["user_id"], "user_state")


@query("r9_recent_buffer", """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS INTEGER) AS position, event_id FROM events QUALIFY position <= 5""")
def r9_recent_buffer(spark, sf):
    rows = _upserted(spark, stateful.recent_rows(event_stream(spark, sf), "user_id", 5), ["user_id", "position"], "recent_buffer")
    return rows.filter("not expired").drop("expired")


@query("r9_idle_users", f"""SELECT user_id, arg_max(event_id, ts) AS last_event FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 12 HOUR <= {_CLOSED}""")
def r9_idle_users(spark, sf):
    """Users whose state a timer has ended: idle for twelve hours of event time when the stream is at its end."""
    rows = _upserted(spark, stateful.recent_rows(event_stream(spark, sf), "user_id", 5, "12 hours"), ["user_id", "position"], "idle_users")
    return rows.filter("expired").select("user_id", F.col("event_id").alias("last_event"))


@query("r10_drift_sensor", f"""WITH h AS (SELECT event_type AS series, time_bucket(INTERVAL 1 HOUR, ts) AS ts, abs({esum('value')} / count(*) - 50) / 100 AS drift FROM events GROUP BY 1, 2
  HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= {_CLOSED}),
m AS (SELECT *, CASE WHEN drift > 0.1 AND ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM h),
r AS (SELECT *, sum(b) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT series, ts, row_number() OVER (PARTITION BY series, run ORDER BY ts) AS breaches FROM r WHERE drift > 0.1 QUALIFY breaches >= 3""")
def r10_drift_sensor(spark, sf):
    """Drift per hour; three breaches in a row raise the sensor while the stream runs. It is stopped half-way: the count goes on."""
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("halves", "sensor", "sensor-offsets"))
    rows = events(spark, sf)
    half = rows.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).first()[0]
    for part in (F.col("ts") < F.lit(half), F.col("ts") >= F.lit(half)):
        rows.filter(part).write.mode("append").parquet(folder)
        sensor = stateful.breach_sensor(stateful.read_event_files(spark, folder, rows.schema), 50, 0.1)
        sinks.drain(sensor.writeStream.format("parquet").option("path", out), checkpoint, "drift_sensor")
    return spark.read.schema("series string, ts timestamp, breaches int").parquet(out).withColumn("ts", F.col("ts").cast(_NTZ))


@query("r11_dead_letters", f"""WITH {ENVELOPE_SQL} SELECT 'dead' AS sink, id, 'Invalid quantity: ' || quantity AS errors FROM env WHERE quantity < 1
UNION ALL SELECT 'table', id, NULL FROM env WHERE quantity >= 1""")
def r11_dead_letters(spark, sf):
    topic, out, dead = (scratch_dir(spark, n) for n in ("topic", "table", "dead"))
    publish_spread(spark, envelope(spark, sf), topic)
    sinks.run_split_sink(sinks.read_topic(spark, topic, 2), out, dead, scratch_dir(spark, "offsets"))
    rejected = spark.read.schema("id string, errors array<string>").json(dead)
    return rejected.select(F.lit("dead").alias("sink"), "id", F.array_join("errors", "; ").alias("errors")).unionByName(
        spark.read.parquet(out).select(F.lit("table").alias("sink"), "id", F.lit(None).cast("string").alias("errors")))


@query("x5_micro_batch_function", f"WITH {ENVELOPE_SQL} SELECT id, CASE WHEN city = 'London' THEN 'EU' ELSE 'UNKNOWN' END AS region FROM env")
def x5_micro_batch_function(spark, sf):
    topic, out = scratch_dir(spark, "topic"), scratch_dir(spark, "batches")
    publish_spread(spark, envelope(spark, sf), topic)

    def enrich(batch, batch_id):
        geo.enrich_region(E.normalize(batch)).select("id", "region").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    sinks.drain(E.decode_envelope(sinks.read_topic(spark, topic, 2)).writeStream.foreachBatch(enrich), scratch_dir(spark, "offsets"), "micro_batch")
    return spark.read.parquet(out).select("id", "region")
