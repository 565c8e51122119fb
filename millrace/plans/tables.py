"""The given tables and the views the queries share, each with the same view as SQL.

``transactions``      typed purchase lines (clean)
``raw_transactions``  the same lines in wire shape, with deterministic faults
``runs`` / ``model_versions`` / ``offsets`` / ``audit_log`` / ``samples``
                      registry, broker, audit and metric tables derived from orders, customer and events
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer and place. Small dimensions are broadcast by Catalyst on their measured size.

    Orders meet their customer and place first, so where customers are too many for a broadcast, orders are shuffled for them and not
    the lines, which are shuffled once. Texts that depend on the order alone (``o_wire_time``, ``o_user``, ``o_place``) are made there as well.
    """
    t = lambda n: table(spark, sf_dir, n)
    placed = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumns({
            "o_wire_time": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "o_user": F.concat(F.lit("usr_"), F.col("o_custkey")),
            "o_place": F.concat_ws(", ", "n_name", "r_name"),
        })
    )
    return t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


LINES_SQL = """lines AS (
  SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("int")
    return _lines(spark, sf_dir).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        F.col("o_orderdate").alias("event_timestamp"),
        F.col("o_user").alias("user_id"),
        F.concat(F.lit("prod_"), F.col("l_partkey")).alias("product_id"),
        F.col("l_extendedprice").alias("price"),
        quantity.alias("quantity"),
        (F.col("l_extendedprice") * quantity).alias("total_amount"),
        F.col("o_place").alias("location"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("channel"),
        F.col("c_mktsegment").alias("device_type"),
    )


TX_SQL = LINES_SQL + """, tx AS (
  SELECT l_orderkey || '-' || l_linenumber AS event_id, o_orderdate AS event_timestamp,
    'usr_' || o_custkey AS user_id, 'prod_' || l_partkey AS product_id, l_extendedprice AS price,
    CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice * CAST(l_quantity AS INTEGER) AS total_amount,
    n_name || ', ' || r_name AS location, r_name AS region, o_orderpriority AS channel, c_mktsegment AS device_type
  FROM lines)"""


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire-shaped records (ISO text time, text ids, metadata map) with faults keyed on the row number."""
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    fault = lambda n: row % n == 0
    return _lines(spark, sf_dir).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.when(fault(97), "not-a-timestamp")
        .otherwise(F.col("o_wire_time")).alias("timestamp"),
        F.when(~fault(79), F.col("o_custkey").cast("string")).alias("user_id"),
        F.when(fault(67), F.concat(F.lit("prod_"), F.col("l_partkey")))
        .otherwise(F.col("l_partkey").cast("string")).alias("product_id"),
        F.when(fault(89), -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(fault(83), 0).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.when(fault(73), F.col("n_name")).otherwise(F.col("o_place")).alias("location"),
        F.create_map(
            F.lit("channel"), F.col("o_orderpriority"),
            F.lit("device_type"), F.col("c_mktsegment"),
            F.lit("session_id"), F.concat(F.lit("s"), F.col("l_orderkey")),
        ).alias("metadata"),
    )


RAW_SQL = LINES_SQL + """, numbered AS (SELECT *, l_orderkey * 10 + l_linenumber AS rn FROM lines), raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS id,
    CASE WHEN rn % 97 = 0 THEN 'not-a-timestamp' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
    CASE WHEN rn % 97 = 0 THEN NULL ELSE o_orderdate END AS parsed_ts,
    CASE WHEN rn % 79 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS user_id,
    CASE WHEN rn % 67 = 0 THEN 'prod_' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
    CASE WHEN rn % 89 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS price,
    CASE WHEN rn % 83 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
    CASE WHEN rn % 73 = 0 THEN n_name ELSE n_name || ', ' || r_name END AS location,
    n_name AS city, CASE WHEN rn % 73 <> 0 THEN r_name END AS country,
    o_orderpriority AS channel, c_mktsegment AS device_type, 's' || l_orderkey AS session_id
  FROM numbered), valid AS (
  SELECT *, 'usr_' || user_id AS norm_user,
    CASE WHEN starts_with(product_id, 'prod_') THEN product_id ELSE 'prod_' || product_id END AS norm_product
  FROM raw WHERE parsed_ts IS NOT NULL AND user_id IS NOT NULL AND price >= 0 AND quantity >= 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as broker records: key, JSON value, topic, partition, offset, timestamp."""
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("key"),
        F.to_json(F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.col("user_id").cast("string").alias("user_id"),
            F.concat(F.lit("p"), F.col("event_type")).alias("product_id"),
            F.col("value").alias("price"),
            F.when(F.col("event_id") % 50 == 0, 0).otherwise(1 + F.col("event_id") % 3).cast("int").alias("quantity"),
            F.when(F.col("event_type") == "view", "London, UK").otherwise("Lyon, France").alias("location"),
            F.create_map(F.lit("channel"), F.col("event_type")).alias("metadata"),
        )).alias("value"),
        F.lit("events.raw.v1").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 3).alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


ENVELOPE_SQL = """env AS (
  SELECT event_id, ts, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, 'p' || event_type AS product_id,
    value AS price, CAST(CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1 + event_id % 3 END AS INTEGER) AS quantity,
    CASE WHEN event_type = 'view' THEN 'London' ELSE 'Lyon' END AS city,
    CASE WHEN event_type = 'view' THEN 'UK' ELSE 'France' END AS country, event_type AS channel,
    CAST(event_id % 3 AS INTEGER) AS kafka_partition, event_id // 3 AS kafka_offset FROM events)"""


# ---------------------------------------------------------------- registry tables

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs: one per order."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), F.col("o_orderkey")).alias("run_id"),
        F.concat(F.lit("exp_"), F.col("o_orderpriority")).alias("experiment"),
        F.concat(F.lit("model_"), F.col("o_custkey") % 25).alias("model_name"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("FAILED").alias("status"),
        F.col("o_orderdate").alias("start_time"),
        F.create_map(F.lit("mape"), price / 16384, F.lit("mse"), price / 128, F.lit("auc"), 1 / (1 + price / 262144))
        .alias("metrics"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("customer"), F.col("o_custkey").cast("string"))
        .alias("params"),
    )


RUNS_SQL = """runs AS (
  SELECT 'run_' || o_orderkey AS run_id, 'exp_' || o_orderpriority AS experiment, 'model_' || (o_custkey % 25) AS model_name,
    CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
    o_orderdate AS start_time, o_totalprice / 16384 AS mape, o_totalprice / 128 AS mse, 1 / (1 + o_totalprice / 262144) AS auc,
    o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders)"""


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered versions: one per customer, the stage read off the market segment."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("model_"), F.col("c_nationkey")).alias("model_name"),
        (F.col("c_custkey") + 1).alias("version"),
        stage_of(F.col("c_mktsegment")).alias("stage"),
        F.concat(F.lit("run_"), F.col("c_custkey")).alias("run_id"),
    )


def stage_of(segment: Column) -> Column:
    return (
        F.when(segment == "BUILDING", "Production").when(segment == "MACHINERY", "Staging")
        .when(segment == "FURNITURE", "Archived").otherwise("None")
    )


VERSIONS_SQL = """versions AS (
  SELECT 'model_' || c_nationkey AS model_name, c_custkey + 1 AS version,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Production' WHEN 'MACHINERY' THEN 'Staging' WHEN 'FURNITURE' THEN 'Archived'
      ELSE 'None' END AS stage, 'run_' || c_custkey AS run_id FROM customer)"""


# ---------------------------------------------------------------- broker tables

def _topic() -> Column:
    return F.when(F.col("event_type") == "signup", "_internal").otherwise(F.col("event_type"))


def end_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(
        _topic().alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition")
    ).agg(F.min("event_id").alias("begin_offset"), (F.max("event_id") + 1).alias("end_offset"))


def committed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consumer groups: one stopped on 20 January, one that never committed errors."""
    done = F.col("event_id") + 1
    per_partition = events(spark, sf_dir).groupBy(
        _topic().alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition")
    ).agg(
        F.max(F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20'"), done)).alias("loader"),
        F.max(F.when(F.col("event_type") != "error", done)).alias("auditor"),
    )
    return per_partition.select(
        F.explode(F.create_map(F.lit("loader"), F.col("loader"), F.lit("auditor"), F.col("auditor")))
        .alias("group_id", "committed"), "topic", "partition")


OFFSETS_SQL = """topics AS (
  SELECT CASE WHEN event_type = 'signup' THEN '_internal' ELSE event_type END AS topic, CAST(user_id % 3 AS INTEGER) AS partition,
    event_id, ts, event_type FROM events),
ends AS (SELECT topic, partition, min(event_id) AS begin_offset, max(event_id) + 1 AS end_offset FROM topics GROUP BY 1, 2),
committed AS (
  SELECT 'loader' AS group_id, topic, partition, max(event_id + 1) FILTER (ts < TIMESTAMP '2024-01-20') AS committed
  FROM topics GROUP BY 2, 3
  UNION ALL
  SELECT 'auditor', topic, partition, max(event_id + 1) FILTER (event_type <> 'error') FROM topics GROUP BY 2, 3)"""


# ---------------------------------------------------------------- audit and metric tables

def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = (
        F.when(F.col("event_type") == "purchase", F.array(F.lit("email"), F.lit("value")))
        .when(F.col("event_type") == "signup", F.array(F.lit("ssn"), F.lit("phone")))
        .otherwise(F.array(F.lit("value")))
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("query_id"),
        F.concat(F.lit("analyst_"), F.col("user_id") % 10).alias("user_name"),
        F.concat(F.lit("SELECT "), F.col("event_type")).alias("query_text"),
        F.array(F.col("event_type")).alias("accessed_tables"),
        touched.alias("accessed_columns"),
        F.col("ts").alias("timestamp"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: a gauge per event type and a counter that resets every 1000 events."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("series"), F.col("ts"), F.col("value").alias("gauge"),
        (F.col("event_id") % 1000).alias("counter"), F.col("event_id").alias("seq"),
    )
