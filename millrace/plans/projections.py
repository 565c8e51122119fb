"""Projections and scalar functions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import geo
from .catalog import query
from .tables import ENVELOPE_SQL, RAW_SQL, TX_SQL, envelope, events, raw_transactions, table, transactions


@query("p1_envelope_decode", f"""WITH {ENVELOPE_SQL}
SELECT user_id AS kafka_key, 'events.raw.v1' AS kafka_topic, kafka_partition, kafka_offset, id, product_id, price, quantity, channel FROM env""")
def p1_envelope_decode(spark, sf):
    return E.decode_envelope(envelope(spark, sf)).select(
        "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "id", "product_id", "price", "quantity",
        F.col("metadata")["channel"].alias("channel"))


@query("p2_json_struct", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS INTEGER) AS wrong_type, CAST(NULL AS INTEGER) AS broken FROM events""")
def p2_json_struct(spark, sf):
    """A wrong type or broken JSON gives NULL, not an error."""
    parse = lambda c, s: F.from_json(c, s)["k"]
    return events(spark, sf).select(
        "event_id",
        parse(F.col("props"), "k int").alias("k"),
        parse(F.concat(F.lit('{"k": '), F.col("value") + 0.001, F.lit("}")), "k int").alias("wrong_type"),
        parse(F.concat(F.lit("{"), F.col("props")), "k int").alias("broken"))


@query("p3_parse_time", f"""WITH {RAW_SQL} SELECT id, product_id, parsed_ts AS event_timestamp FROM raw""")
def p3_parse_time(spark, sf):
    return raw_transactions(spark, sf).select(
        "id", "product_id", S.iso_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("event_timestamp"))


@query("p4_day_and_hour", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt, hour(ts) AS event_hour FROM events""")
def p4_day_and_hour(spark, sf):
    return events(spark, sf).select("event_id", S.partition_day(F.col("ts")).alias("dt"), F.hour("ts").alias("event_hour"))


@query("p5_trim", """SELECT c_custkey, trim('  ' || c_name || ' ') AS name, trim(' ' || c_mktsegment) AS segment FROM customer""")
def p5_trim(spark, sf):
    padded = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.concat(F.lit(" "), "c_mktsegment").alias("segment"))
    return padded.withColumns({c: F.trim(F.col(c)) for c in ("name", "segment")})


@query("p6_id_prefix", f"""WITH {RAW_SQL} SELECT id, 'usr_' || user_id AS user_id,
  CASE WHEN starts_with(product_id, 'prod_') THEN product_id ELSE 'prod_' || product_id END AS product_id FROM raw""")
def p6_id_prefix(spark, sf):
    return raw_transactions(spark, sf).select(
        "id", S.with_prefix(F.col("user_id"), "usr_").alias("user_id"), S.with_prefix(F.col("product_id"), "prod_").alias("product_id"))


@query("p7_city_country", f"""WITH {RAW_SQL}
SELECT id, product_id, trim(split_part(location, ',', 1)) AS city, nullif(trim(split_part(location, ',', 2)), '') AS country FROM raw""")
def p7_city_country(spark, sf):
    place = F.col("location")
    return raw_transactions(spark, sf).select(
        "id", "product_id", S.location_part(place, 0).alias("city"), S.location_part(place, 1).alias("country"))


@query("p8_region", f"""WITH {RAW_SQL}
SELECT id, product_id, CASE WHEN contains(location, ',') THEN trim(split_part(location, ',', -1)) ELSE 'Unknown' END AS region FROM raw""")
def p8_region(spark, sf):
    return raw_transactions(spark, sf).select("id", "product_id", S.region_of(F.col("location")).alias("region"))


@query("p9_line_total", f"""WITH {TX_SQL}
SELECT event_id, product_id, CAST(CAST(price AS DECIMAL(18,2)) * quantity AS DOUBLE) AS total, price * quantity AS revenue FROM tx""")
def p9_line_total(spark, sf):
    price, quantity = F.col("price"), F.col("quantity")
    return transactions(spark, sf).select(
        "event_id", "product_id", S.line_total(price, quantity).alias("total"), (price * quantity).alias("revenue"))


@query("p10_map_fields", f"""WITH {RAW_SQL} SELECT id, product_id, channel, device_type, session_id, CAST(NULL AS VARCHAR) AS referrer FROM raw""")
def p10_map_fields(spark, sf):
    return raw_transactions(spark, sf).select(
        "id", "product_id", *[F.col("metadata")[k].alias(k) for k in ("channel", "device_type", "session_id", "referrer")])


@query("p11_json_map", """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def p11_json_map(spark, sf):
    parsed = F.from_json("props", "map<string,string>")
    return events(spark, sf).select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


@query("p12_tags", """
SELECT event_id, t AS tag FROM (SELECT event_id, unnest([event_type, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR)]) AS t FROM events WHERE event_type <> 'view')
UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'view'""")
def p12_tags(spark, sf):
    """Arrays inside the metadata map arrive as JSON text; an event without tags keeps one row."""
    tags = F.to_json(F.array(F.col("event_type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))))
    metadata = F.when(F.col("event_type") != "view", F.create_map(F.lit("tags"), tags))
    return events(spark, sf).select("event_id", metadata.alias("metadata")).select(
        "event_id", F.explode_outer(F.from_json(F.col("metadata")["tags"], "array<string>")).alias("tag"))


@query("p13_processing_stamps", """SELECT event_id, true AS stamped FROM events""")
def p13_processing_stamps(spark, sf):
    return events(spark, sf).select(
        "event_id", F.current_timestamp().alias("processed_at"), F.current_date().alias("processing_date")
    ).select("event_id", (F.to_date("processed_at") == F.col("processing_date")).alias("stamped"))


@query("p14_canonical_event", f"""WITH {RAW_SQL}
SELECT id AS event_id, 'transaction' AS event_type, "timestamp" AS event_time, norm_user AS user_id, session_id, norm_product AS product_id,
  price, quantity, CAST(CAST(price AS DECIMAL(18,2)) * quantity AS DOUBLE) AS total, location AS raw, city, country, 'UNKNOWN' AS region,
  channel, device_type, strftime(parsed_ts, '%Y-%m-%d') AS partition_date FROM valid""")
def p14_canonical_event(spark, sf):
    """The session is blanked first, so it comes back from the metadata map."""
    df = geo.enrich_region(E.normalize(E.drop_malformed(raw_transactions(spark, sf)))).withColumn("session_id", F.lit(""))
    return df.select(E.canonical_event().alias("e")).select(
        "e.event_id", "e.event_type", "e.event_time", F.col("e.user.id").alias("user_id"), "e.user.session_id",
        F.col("e.product.id").alias("product_id"), "e.transaction.*", "e.location.*", "e.channel", "e.device_type", "e.partition_date")


@query("p15_stream_columns", f"""WITH {ENVELOPE_SQL}
SELECT id, ts AS event_timestamp, strftime(ts, '%Y-%m-%d') AS dt, hour(ts) AS event_hour, kafka_offset, kafka_partition, ts AS kafka_timestamp,
  'usr_' || user_id AS user_id, 'prod_' || product_id AS product_id, price, quantity, CAST(CAST(price AS DECIMAL(18,2)) * quantity AS DOUBLE) AS total_amount,
  city || ', ' || country AS location, city, country, CASE WHEN city = 'London' THEN 'EU' ELSE 'UNKNOWN' END AS region, channel,
  CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS session_id FROM env WHERE quantity >= 1""")
def p15_stream_columns(spark, sf):
    df = geo.enrich_region(E.normalize(E.drop_malformed(E.decode_envelope(envelope(spark, sf)))))
    out = df.select(*E.STREAM_COLUMNS).drop("processed_at", "processing_date")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("event_timestamp", "kafka_timestamp")})


@query("p15_batch_columns", f"""WITH {RAW_SQL}
SELECT id, parsed_ts AS event_timestamp, strftime(parsed_ts, '%Y-%m-%d') AS dt, 'usr_' || user_id AS user_id,
  CASE WHEN starts_with(product_id, 'prod_') THEN product_id ELSE 'prod_' || product_id END AS product_id, price, quantity,
  CAST(CAST(price AS DECIMAL(18,2)) * quantity AS DOUBLE) AS total_amount, location, city, country, channel, device_type, session_id
FROM raw WHERE parsed_ts IS NOT NULL AND price >= 0 AND quantity >= 1""")
def p15_batch_columns(spark, sf):
    wire = raw_transactions(spark, sf).withColumn("metadata", F.to_json("metadata"))
    df = E.normalize(wire, trim=True).filter(E.is_loadable())
    out = df.select(*E.BATCH_COLUMNS).drop("metadata", "processed_at", "processing_date")
    return out.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


@query("p16_adapt_columns", f"""WITH {RAW_SQL}
SELECT id AS event_id, parsed_ts AS event_timestamp, price * quantity AS total_amount, 'usr_' || user_id AS user_id, channel FROM raw""")
def p16_adapt_columns(spark, sf):
    return E.adapt_columns(raw_transactions(spark, sf)).select(
        "event_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "total_amount", "user_id",
        F.col("metadata")["channel"].alias("channel"))


@query("p17_model_features", """
SELECT event_id, value AS f_price, CAST(1 AS INTEGER) AS f_quantity, hour(ts) AS f_hour, isodow(ts) - 1 AS f_weekday FROM events""")
def p17_model_features(spark, sf):
    return E.model_features(events(spark, sf), price="value").select("event_id", "f_price", "f_quantity", "f_hour", "f_weekday")


_MD5 = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


@query("p18_hash_bucket", f"""SELECT {_MD5.format('CAST(user_id AS VARCHAR)')} % 1000 AS user_bucket, {_MD5.format('event_type')} % 500 AS type_bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def p18_hash_bucket(spark, sf):
    return events(spark, sf).select(
        S.hash_bucket(F.col("user_id").cast("string"), 1000).alias("user_bucket"),
        S.hash_bucket(F.col("event_type"), 500).alias("type_bucket")).groupBy("user_bucket", "type_bucket").agg(F.count("*").alias("n"))


@query("p19_calendar", """SELECT event_id, CAST(ts AS DATE) AS date, hour(ts) AS hour, dayname(ts) AS day_name FROM events""")
def p19_calendar(spark, sf):
    return events(spark, sf).select(
        "event_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("day_name"))


@query("p20_normalize_path", r"""
SELECT page_id, regexp_replace(regexp_replace(split_part(CASE WHEN page_id % 2 = 0 THEN split_part(url, '?', 1) || '/123e4567-e89b-12d3-a456-426614174000' ELSE url END, '?', 1),
    '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '{id}', 'g'), '/\d+', '/{id}', 'g') AS path FROM pages""")
def p20_normalize_path(spark, sf):
    """Half of the addresses get a UUID part, so both rules apply."""
    url = F.when(F.col("page_id") % 2 == 0, F.concat(
        F.split("url", r"\?")[0], F.lit("/123e4567-e89b-12d3-a456-426614174000"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", S.normalize_path(url).alias("path"))


@query("p21_document_ids", """
SELECT doc_id, md5(source || '/' || doc_id)[1:12] AS short_id, md5(source || '/' || doc_id)[1:12] || '_0' AS chunk_id FROM documents""")
def p21_document_ids(spark, sf):
    short = S.short_md5(F.concat_ws("/", "source", "doc_id"))
    return table(spark, sf, "documents").select("doc_id", short.alias("short_id"), F.concat(short, F.lit("_0")).alias("chunk_id"))


@query("p22_display_fields", """
SELECT event_id, md5(CAST(event_id AS VARCHAR))[1:12] AS short_id, coalesce(nullif(value, 0), 0) AS value,
  CASE WHEN event_id * 997 < 1000000 THEN format('{:,}', event_id * 997) ELSE format('{:.1f}M', event_id * 997 / 1000000.0) END AS shown FROM events""")
def p22_display_fields(spark, sf):
    return events(spark, sf).select(
        "event_id", F.substring(F.md5(F.col("event_id").cast("string")), 1, 12).alias("short_id"),
        F.coalesce(F.nullif(F.col("value"), F.lit(0.0)), F.lit(0.0)).alias("value"),
        S.compact_count(F.col("event_id") * 997).alias("shown"))


@query("p23_transcript_fields", """WITH t AS (
  SELECT conv_id, turn, role, trim(replace(text, chr(10), ' ')) AS clean FROM conversations)
SELECT conv_id, turn, clean AS thought, CASE WHEN role <> 'assistant' THEN 'search_' || role END AS action,
  CASE WHEN role <> 'assistant' THEN CAST(turn AS VARCHAR) END AS input_turn, CASE WHEN role = 'assistant' THEN clean || chr(10) || turn END AS final_answer FROM t""")
def p23_transcript_fields(spark, sf):
    """Assistant turns as final answers, all others as tool calls, written in the agent's text form."""
    clean = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    turn = F.col("turn").cast("string")
    message = F.when(F.col("role") == "assistant", F.concat(
        F.lit("Thought: "), clean, F.lit("\nFINAL_ANSWER: "), clean, F.lit("\n"), turn)).otherwise(F.concat(
            F.lit("Thought: "), clean, F.lit("\nAction: search_"), F.col("role"), F.lit('\nAction Input: {"turn": '), turn, F.lit("}")))
    return table(spark, sf, "conversations").select("conv_id", "turn", S.parse_transcript(message).alias("p")).select(
        "conv_id", "turn", F.trim(F.regexp_replace("p.thought", r"\s+\z", "")).alias("thought"), "p.action",
        F.col("p.action_input")["turn"].alias("input_turn"), "p.final_answer")


@query("p24_location_shapes", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE n_name END AS city,
  CASE c_custkey % 4 WHEN 0 THEN r_name WHEN 1 THEN r_name END AS country,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 4 = 0 THEN CAST(-(c_custkey % 180) AS DOUBLE) END AS lon
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def p24_location_shapes(spark, sf):
    """JSON object, ``City, Country``, bare city and NULL, by customer number."""
    key = F.col("c_custkey")
    as_object = F.to_json(F.struct(
        F.col("n_name").alias("city"), F.col("r_name").alias("region"), (key % 90).cast("double").alias("latitude"),
        (-(key % 180)).cast("double").alias("longitude")))
    shape = F.when(key % 4 == 0, as_object).when(key % 4 == 1, F.concat_ws(", ", "n_name", "r_name")).when(key % 4 == 2, F.col("n_name"))
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", S.location_struct(shape).alias("p")).select("c_custkey", "p.*")


@query("p25_arrays_to_rows", """
SELECT event_id, unnest(['value', 'hour']) AS feature, unnest([value, CAST(hour(ts) AS DOUBLE)]) AS value, unnest([value * 2, CAST(hour(ts) * 3 AS DOUBLE)]) AS contribution FROM events""")
def p25_arrays_to_rows(spark, sf):
    hour = F.hour("ts").cast("double")
    packed = events(spark, sf).select(
        "event_id", F.array(F.lit("value"), F.lit("hour")).alias("feature"), F.array("value", hour).alias("value"),
        F.array(F.col("value") * 2, hour * 3).alias("contribution"))
    return packed.select("event_id", F.inline(F.arrays_zip("feature", "value", "contribution")))
