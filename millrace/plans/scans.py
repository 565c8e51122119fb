"""Sources and sinks (S)."""

from __future__ import annotations

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import features, geo, retrieval
from ..session import scratch_dir
from ..sources import files, lake, snapshot
from ..streaming import log_source, sinks
from .catalog import query
from .features_sql import USER_FEATURES_SQL
from .tables import ENVELOPE_SQL, RAW_SQL, envelope, events, raw_transactions, table, transactions


def _spread(spark) -> int:
    """Files of a topic: as many as a shuffle has partitions, several at least."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("s1_jsonl_scan", f"""WITH {RAW_SQL}
SELECT id, "timestamp", user_id, product_id, price, quantity, location, channel FROM raw""")
def s1_jsonl_scan(spark, sf):
    path = scratch_dir(spark, "jsonl") + "/events.jsonl"
    raw_transactions(spark, sf).write.json(path)
    df = files.read_events(spark, path, "jsonl")
    return df.filter(F.col(files.CORRUPT).isNull()).select(
        "id", "timestamp", "user_id", "product_id", "price", "quantity", "location", F.col("metadata")["channel"].alias("channel"))


@query("s2_parquet_scan", """
SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity >= 25 AND l_shipdate >= TIMESTAMP '1998-01-01'""")
def s2_parquet_scan(spark, sf):
    return table(spark, sf, "lineitem").filter(
        (F.col("l_quantity") >= 25) & (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01'"))
    ).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("s3_source_detection", """
SELECT layout, format, event_type, count(*) AS n FROM events
CROSS JOIN (VALUES ('named_parquet', 'parquet'), ('named_jsonl', 'jsonl'), ('any_parquet', 'parquet'), ('any_json', 'jsonl')) v(layout, format)
GROUP BY ALL""")
def s3_source_detection(spark, sf):
    root = scratch_dir(spark, "landing")
    wire = events(spark, sf).select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("location"))
    wire.write.parquet(f"{root}/named_parquet/events.parquet")
    wire.write.json(f"{root}/named_jsonl/events.jsonl")
    wire.write.parquet(f"{root}/any_parquet")
    wire.write.json(f"{root}/any_json")
    parts = []
    for layout in ("named_parquet", "named_jsonl", "any_parquet", "any_json"):
        fmt, _ = files.detect_source(spark, f"{root}/{layout}")
        parts.append(files.read_events(spark, f"{root}/{layout}").select(
            F.lit(layout).alias("layout"), F.lit(fmt).alias("format"), F.col("location").alias("event_type")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("layout", "format", "event_type").agg(F.count("*").alias("n"))


@query("s4_lake_or_raw", """
SELECT 'fallback' AS source, event_id, event_type FROM events UNION ALL
SELECT 'lake', event_id, event_type FROM events WHERE event_type = 'purchase'""")
def s4_lake_or_raw(spark, sf):
    raw = f"{sf}/events.parquet"
    root = scratch_dir(spark, "lake")
    fallback = files.read_lake_or_raw(spark, f"{root}/missing", raw)
    events(spark, sf).filter("event_type = 'purchase'").write.parquet(f"{root}/events")
    stored = files.read_lake_or_raw(spark, f"{root}/events", raw)
    pick = lambda df, s: df.select(F.lit(s).alias("source"), "event_id", "event_type")
    return pick(fallback, "fallback").unionByName(pick(stored, "lake"))


@query("s5_stream_source", f"""WITH {ENVELOPE_SQL}
SELECT id, user_id, price, quantity, kafka_partition, kafka_offset, ts AS kafka_timestamp FROM env""")
def s5_stream_source(spark, sf):
    topic, out = scratch_dir(spark, "topic"), scratch_dir(spark, "decoded")
    sinks.publish(envelope(spark, sf), topic, files=_spread(spark))
    stream = E.decode_envelope(sinks.read_topic(spark, topic, max_files_per_trigger=2))
    sinks.drain(stream.writeStream.format("parquet").option("path", out), scratch_dir(spark, "offsets"))
    return spark.read.parquet(out).select(
        "id", "user_id", "price", "quantity", "kafka_partition", "kafka_offset",
        F.col("kafka_timestamp").cast("timestamp_ntz").alias("kafka_timestamp"))


def _segment_size(records) -> int:
    """About ten segments a partition, as the query has three of them."""
    return max(1, records.count() // 30)


def _log_rows(spark, path):
    return spark.read.parquet(path).select(
        "key", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").cast("timestamp_ntz").alias("kafka_timestamp"))


@query("s5_log_offsets", f"""WITH {ENVELOPE_SQL}, m AS (SELECT kafka_partition AS p, max(kafka_offset) // 2 AS half FROM env GROUP BY 1)
SELECT user_id AS key, kafka_partition, kafka_offset, ts AS kafka_timestamp FROM env JOIN m ON kafka_partition = p WHERE p = 1 OR kafka_offset >= half""")
def s5_log_offsets(spark, sf):
    """A log read from given offsets, the middle of two partitions and the beginning of the third, 10,000 records a trigger."""
    records = envelope(spark, sf)
    log, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "read", "offsets"))
    size = _segment_size(records)
    log_source.publish_log(records, log, size)
    half = {str(r["partition"]): r["half"] for r in records.groupBy("partition").agg(F.floor(F.max("offset") / 2).alias("half")).collect()}  # a row a partition
    half.pop("1", None)
    stream = log_source.read_log(spark, log, checkpoint, segmentRecords=size, startingOffsets=json.dumps(half))
    sinks.run_to_end(stream.writeStream.format("parquet").option("path", out), checkpoint)
    return _log_rows(spark, out)


@query("s5_data_loss", f"""WITH {ENVELOPE_SQL}, z AS (SELECT greatest(1, count(*) // 30) AS size FROM env),
left_over AS (SELECT count(*) AS n FROM env, z WHERE NOT (kafka_partition = 2 AND kafka_offset // size = 1))
SELECT 'tolerated' AS mode, n AS records, false AS stopped FROM left_over UNION ALL SELECT 'strict', NULL, true""")
def s5_data_loss(spark, sf):
    """A log that lost a segment in its middle: the records that are left, or a stream that stops."""
    records = envelope(spark, sf)
    log, size = scratch_dir(spark, "log"), _segment_size(records)
    lost = (F.col("partition") == 2) & (F.floor(F.col("offset") / size) == 1)
    log_source.publish_log(records.filter(~lost), log, size)
    rows = []
    for mode in ("tolerated", "strict"):
        out, checkpoint, stopped = scratch_dir(spark, mode), scratch_dir(spark, "offsets"), False
        stream = log_source.read_log(spark, log, checkpoint, segmentRecords=size, failOnDataLoss=mode == "strict")
        try:
            sinks.run_to_end(stream.writeStream.format("parquet").option("path", out), checkpoint)
        except StreamingQueryException as e:
            stopped = "data loss" in str(e)
        rows.append((mode, None if stopped else spark.read.parquet(out).count(), stopped))
    return spark.createDataFrame(rows, "mode string, records long, stopped boolean")


@query("s6_publish_keyed", """
SELECT CAST(user_id AS VARCHAR) AS key, event_id, user_id, event_type, value, props FROM events""")
def s6_publish_keyed(spark, sf):
    topic = scratch_dir(spark, "topic")
    sinks.publish(E.keyed_messages(events(spark, sf), "user_id"), topic, files=_spread(spark))
    stored = spark.read.schema("key string, value string").json(topic)
    return stored.select("key", F.from_json("value", "event_id long, user_id long, event_type string, value double, props string").alias("v")).select(
        "key", "v.*")


@query("s7_csv_scan", f"""WITH {RAW_SQL} SELECT id, user_id, price, quantity, location FROM raw""")
def s7_csv_scan(spark, sf):
    path = scratch_dir(spark, "csv")
    raw_transactions(spark, sf).select("id", "user_id", "price", "quantity", "location").write.csv(path, header=True)
    return files.read_csv(spark, path, "id string, user_id string, price double, quantity int, location string")


@query("s8_document_scan", r"""
SELECT 'txt' AS kind, item_id, text AS content FROM benchmark
UNION ALL SELECT 'content', item_id, text FROM benchmark UNION ALL SELECT 'text', item_id, text FROM benchmark""")
def s8_document_scan(spark, sf):
    root = scratch_dir(spark, "docs")
    items = table(spark, sf, "benchmark").repartition("item_id")
    items.write.partitionBy("item_id").text(f"{root}/kind=txt")
    items.select("item_id", F.col("text").alias("content")).write.partitionBy("item_id").json(f"{root}/kind=content")
    items.write.partitionBy("item_id").json(f"{root}/kind=text")
    docs = files.read_documents(spark, root)
    item = F.regexp_extract("source", r"item_id=(\d+)", 1).cast("long")
    kind = F.regexp_extract("source", r"kind=(\w+)/", 1)
    # The text writer ends each file with a line feed.
    return docs.select(kind.alias("kind"), item.alias("item_id"), F.regexp_replace("content", r"\n\z", "").alias("content"))


@query("s9_geo_dimension", """
SELECT 'box' AS kind, r_name AS name, 'R' || r_regionkey AS code, CAST(-80 + 30 * r_regionkey AS DOUBLE) AS lat, 180.0 AS lon FROM region
UNION ALL SELECT 'city', n_name, 'R' || n_regionkey, CAST(n_nationkey AS DOUBLE), CAST(-n_nationkey AS DOUBLE) FROM nation""")
def s9_geo_dimension(spark, sf):
    path = scratch_dir(spark, "geo")
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    # Both lists have one entry per row of a dimension table.
    boxes = region.agg(F.array_sort(F.collect_list(F.struct(
        F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.concat(F.lit("R"), "r_regionkey").alias("code"),
        F.struct((-80.0 + 30 * F.col("r_regionkey")).alias("min_lat"), F.lit(80.0).alias("max_lat"), F.lit(-180.0).alias("min_lon")).alias("bounds"),
    ))).alias("regions"))
    cities = nation.agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(
        F.concat(F.lit("R"), "n_regionkey").alias("region"), F.col("n_nationkey").cast("double").alias("lat"),
        (-F.col("n_nationkey")).cast("double").alias("lon"))))).alias("c"))
    boxes.withColumn("city_overrides", cities.scalar()).write.json(path)
    box_rows, city_rows = geo.load_dimension(spark, path)
    return box_rows.select(F.lit("box").alias("kind"), "name", "code", F.col("min_lat").alias("lat"), F.col("max_lon").alias("lon")).unionByName(
        city_rows.select(F.lit("city").alias("kind"), F.col("city").alias("name"), F.col("region").alias("code"), "lat", "lon"))


VIOLATIONS_SQL = """concat_ws('; ',
    CASE WHEN user_id IS NULL THEN 'Missing required field: user_id' END,
    CASE WHEN price < 0 THEN 'Invalid price' END,
    CASE WHEN quantity < 1 THEN 'Invalid quantity: ' || quantity END,
    CASE WHEN parsed_ts IS NULL THEN 'Invalid timestamp format: ' || "timestamp" END"""


@query("s10_contract_check", f"""WITH {RAW_SQL}
SELECT id, product_id, {VIOLATIONS_SQL}, 'Unknown channel: ' || channel) AS violations FROM raw""")
def s10_contract_check(spark, sf):
    return raw_transactions(spark, sf).select(
        "id", "product_id",
        F.regexp_replace(F.array_join(E.contract_violations(), "; "), r"(Invalid price): [-0-9.E]+", "$1").alias("violations"))


@query("s11_partitioned_write", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt, CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-10' THEN value * 2 ELSE value END AS value,
  CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-10' THEN event_type END AS note FROM events""")
def s11_partitioned_write(spark, sf):
    """A later overwrite of one day, with one more column, leaves the other days as they are."""
    path = scratch_dir(spark, "lake")
    daily = events(spark, sf).select("event_id", "value", "event_type", S.partition_day(F.col("ts")).alias("dt"))
    lake.write_table(daily.drop("event_type"), path)
    fixed = daily.filter("dt = '2024-01-10'").withColumn("value", F.col("value") * 2).withColumnRenamed("event_type", "note")
    lake.write_table(fixed, path, mode="overwrite")
    return lake.read_table(spark, path, merge_schema=True).select("event_id", "dt", "value", "note")


NORMALIZED_SQL = f"""{ENVELOPE_SQL}, good AS (
  SELECT id, 'usr_' || user_id AS user_id, 'prod_' || product_id AS product_id, price, quantity,
    CAST(round(CAST(price AS DECIMAL(18,2)) * quantity, 2) AS DOUBLE) AS total_amount, city, country, channel,
    CASE WHEN city = 'London' THEN 'EU' ELSE 'UNKNOWN' END AS region, strftime(ts, '%Y-%m-%d') AS dt, ts
  FROM env WHERE quantity >= 1 AND price >= 0)"""


@query("s12_dual_sink", f"""WITH {NORMALIZED_SQL}
SELECT 'table' AS sink, id, user_id, total_amount, region FROM good UNION ALL SELECT 'topic', id, user_id, total_amount, region FROM good""")
def s12_dual_sink(spark, sf):
    topic, out, mirror = (scratch_dir(spark, n) for n in ("topic", "table", "mirror"))
    sinks.publish(envelope(spark, sf), topic, files=_spread(spark))
    sinks.run_dual_sink(sinks.ingest(sinks.read_topic(spark, topic, 2)), out, mirror, scratch_dir(spark, "offsets"))
    fields = "event_id string, user struct<id:string>, transaction struct<total:double>, location struct<region:string>"
    sent = sinks.read_messages(spark, mirror).select(F.from_json("value", fields).alias("v"))
    return lake.read_table(spark, out).select(F.lit("table").alias("sink"), "id", "user_id", "total_amount", "region").unionByName(
        sent.select(F.lit("topic").alias("sink"), F.col("v.event_id").alias("id"), F.col("v.user.id").alias("user_id"),
                    F.col("v.transaction.total").alias("total_amount"), F.col("v.location.region").alias("region")))


@query("s13_canonical_topic", f"""WITH {RAW_SQL}
SELECT norm_user AS key, id, norm_product AS product_id, city, country, country IS NULL AS null_kept, channel FROM valid""")
def s13_canonical_topic(spark, sf):
    df = geo.enrich_region(E.normalize(E.drop_malformed(raw_transactions(spark, sf))))
    v = F.from_json("value", "event_id string, product struct<id:string>, location struct<city:string,country:string>, channel string")
    return E.canonical_messages(df).select("key", v.alias("v"), F.col("value").contains('"country":null').alias("null_kept")).select(
        "key", F.col("v.event_id").alias("id"), F.col("v.product.id").alias("product_id"), "v.location.city", "v.location.country",
        "null_kept", "v.channel")


@query("s14_feature_table", USER_FEATURES_SQL)
def s14_feature_table(spark, sf):
    path = scratch_dir(spark, "features")
    rows = features.user_features(transactions(spark, sf), features.latest(table(spark, sf, "orders"), "o_orderdate"))
    rows.withColumn("as_of", S.partition_day(F.col("event_timestamp"))).write.partitionBy("as_of").parquet(path)
    return spark.read.parquet(path).drop("as_of", "event_timestamp", "created_timestamp")


def _snapshot(spark, sf):
    """A first load, an increment that updates some users and adds others, and the increment again: (path, changes of every merge)."""
    path = scratch_dir(spark, "online")
    rows = events(spark, sf).select("user_id", "event_id", "ts", "value")
    half = F.expr("TIMESTAMP_NTZ '2024-01-15'")
    later = rows.filter(F.col("ts") >= half)
    return path, [snapshot.merge(spark, part, path, ["user_id"], "ts") for part in (rows.filter(F.col("ts") < half), later, later)]


@query("s15_online_snapshot", """
SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def s15_online_snapshot(spark, sf):
    path, _ = _snapshot(spark, sf)
    return snapshot.read(spark, path, ["user_id"], "ts")


@query("s15_merge_report", """WITH u AS (SELECT user_id, min(ts) < TIMESTAMP '2024-01-15' AS early, max(ts) >= TIMESTAMP '2024-01-15' AS late FROM events GROUP BY 1)
SELECT 1 AS merge, count(*) AS rows_written FROM u WHERE early HAVING count(*) > 0
UNION ALL SELECT 2, count(*) FILTER (early OR late) FROM u HAVING count(*) FILTER (late) > 0""")
def s15_merge_report(spark, sf):
    """Rows that each merge wrote; the increment touches most users, so the bucket is rewritten, and coming again it writes nothing."""
    _, changes = _snapshot(spark, sf)
    rows = [c.withColumn("merge", F.lit(i)) for i, c in enumerate(changes, 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("merge").agg(F.sum("rows").alias("rows_written"))


@query("s16_vector_index", """
SELECT vec_id, label AS cell, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings""")
def s16_vector_index(spark, sf):
    path = scratch_dir(spark, "index")
    retrieval.save_index(table(spark, sf, "embeddings").withColumnRenamed("label", "cell"), path)
    return retrieval.load_index(spark, path).select(
        "vec_id", F.col("cell").cast("int").alias("cell"), F.size("embedding").alias("dim"), F.col("embedding")[0].cast("double").alias("first"))


@query("s18_compaction_retention", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt, value FROM events WHERE ts >= TIMESTAMP '2024-01-20'""")
def s18_compaction_retention(spark, sf):
    path = scratch_dir(spark, "lake")
    daily = events(spark, sf).select("event_id", "value", S.partition_day(F.col("ts")).alias("dt"))
    lake.write_table(daily, path, files_per_partition=4)
    lake.compact_files(spark, path)
    return lake.retain(lake.read_table(spark, path), "2024-01-30", 10)


@query("s18_layer_retention", """
WITH d AS (SELECT max(o_orderdate) AS newest FROM orders), k AS (SELECT * FROM (VALUES ('bronze', 90), ('silver', 365), ('gold', 1095)) v(layer, days))
SELECT layer, strftime(o_orderdate, '%Y-%m-01') AS dt, count(*) AS n FROM orders, d, k
WHERE strftime(o_orderdate, '%Y-%m-01') >= strftime(CAST(newest AS DATE) - days::INTEGER, '%Y-%m-%d') GROUP BY ALL""")
def s18_layer_retention(spark, sf):
    """The folders of three layers that are past their time are deleted; what is left is read."""
    root = scratch_dir(spark, "layers")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("dt"))
    for layer in lake.RETENTION_DAYS:
        lake.write_table(orders, f"{root}/{layer}")
    newest = orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).first()[0]
    lake.apply_retention(spark, root, newest)
    left = [lake.read_table(spark, f"{root}/{layer}").groupBy("dt").agg(F.count("*").alias("n")).withColumn("layer", F.lit(layer)) for layer in lake.RETENTION_DAYS]
    return left[0].unionByName(left[1]).unionByName(left[2]).select("layer", "dt", "n")


@query("s19_live_feed", f"""WITH {ENVELOPE_SQL}
SELECT id, user_id, price, ts FROM env ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def s19_live_feed(spark, sf):
    topic, out = scratch_dir(spark, "topic"), scratch_dir(spark, "recent")
    sinks.publish(envelope(spark, sf), topic, files=_spread(spark))
    stream = E.decode_envelope(sinks.read_topic(spark, topic, 2)).filter(F.col("id").isNotNull())
    sinks.run_recent_feed(stream, out, scratch_dir(spark, "offsets"), order=["kafka_timestamp", "kafka_offset", "kafka_partition"], keep=1000)
    return sinks.read_latest_batch(spark, out).select("id", "user_id", "price", F.col("kafka_timestamp").cast("timestamp_ntz").alias("ts"))


@query("s21_layered_flow", f"""WITH {RAW_SQL}, silver AS (
  SELECT strftime(parsed_ts, '%Y-%m-%d') AS dt, CAST(price * quantity AS DECIMAL(18,4)) AS amount, norm_user FROM valid)
SELECT 'bronze' AS layer, NULL AS dt, count(*) AS n, NULL AS revenue FROM raw
UNION ALL SELECT 'silver', NULL, count(*), NULL FROM silver
UNION ALL SELECT 'quarantine', NULL, (SELECT count(*) FROM raw) - count(*), NULL FROM silver
UNION ALL SELECT 'gold', dt, count(*), CAST(sum(amount) AS DOUBLE) FROM silver GROUP BY dt""")
def s21_layered_flow(spark, sf):
    """One write splits raw rows into silver and quarantine; gold reads silver only."""
    path = scratch_dir(spark, "layers")
    lake.split_valid(raw_transactions(spark, sf), E.violations()).write.partitionBy("layer").parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy("layer").agg(F.count("*").alias("n"))
    total = stored.agg(F.lit("bronze").alias("layer"), F.count("*").alias("n"))
    silver = E.normalize(stored.filter("layer = 'silver'"))
    gold = silver.groupBy("dt").agg(F.count("*").alias("n"), S.stable_sum(F.col("price") * F.col("quantity")).alias("revenue"))
    none = lambda t: F.lit(None).cast(t)
    wide = total.unionByName(counts).select("layer", none("string").alias("dt"), "n", none("double").alias("revenue"))
    return wide.unionByName(gold.select(F.lit("gold").alias("layer"), "dt", "n", "revenue"))
