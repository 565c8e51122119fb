"""Filters and predicates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts, events as E
from ..operators import features, offsets, registry, retrieval
from .catalog import query
from .monitoring_sql import ALERTS_SQL
from .retrieval_sql import CENTROIDS_SQL
from .scans import VIOLATIONS_SQL
from .tables import OFFSETS_SQL, RAW_SQL, RUNS_SQL, TX_SQL, end_offsets, events, raw_transactions, runs, table, transactions


@query("f1_drop_malformed", f"""WITH {RAW_SQL} SELECT id, user_id, product_id, price, quantity FROM valid""")
def f1_drop_malformed(spark, sf):
    return E.drop_malformed(raw_transactions(spark, sf)).select("id", "user_id", "product_id", "price", "quantity")


@query("f2_batch_validity", f"""WITH {RAW_SQL}
SELECT id, product_id, price, quantity FROM raw WHERE id IS NOT NULL AND parsed_ts IS NOT NULL AND price >= 0 AND quantity >= 1""")
def f2_batch_validity(spark, sf):
    wire = raw_transactions(spark, sf).withColumn("event_timestamp", S.iso_timestamp(F.col("timestamp")))
    return wire.filter(E.is_loadable()).select("id", "product_id", "price", "quantity")


@query("f3_record_errors", f"""WITH {RAW_SQL}, e AS (SELECT id, product_id, {VIOLATIONS_SQL}) AS errors FROM raw)
SELECT id, product_id, errors, errors = '' AS is_valid FROM e""")
def f3_record_errors(spark, sf):
    return E.with_validity(raw_transactions(spark, sf)).select(
        "id", "product_id", F.regexp_replace(F.array_join("errors", "; "), r"(Invalid price): [-0-9.E]+", "$1").alias("errors"), "is_valid")


@query("f4_date_restriction", """SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'""")
def f4_date_restriction(spark, sf):
    """On raw files the day becomes a time range, so the filter reaches the scan."""
    day = lambda d: F.expr(f"TIMESTAMP_NTZ '{d}'")
    return events(spark, sf).filter((F.col("ts") >= day("2024-01-15")) & (F.col("ts") < day("2024-01-16"))).select("event_id", "value")


@query("f5_lookback", f"""WITH {TX_SQL}
SELECT 'window' AS kind, event_id, product_id FROM tx WHERE event_timestamp >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
UNION ALL SELECT 'fallback', event_id, product_id FROM tx""")
def f5_lookback(spark, sf):
    """The second half asks for a window after the data ends, which falls back to the whole table."""
    tx = transactions(spark, sf)
    as_of = features.latest(table(spark, sf, "orders"), "o_orderdate")
    late = F.expr("TIMESTAMP_NTZ '2030-01-01'")
    pick = lambda df, k: df.select(F.lit(k).alias("kind"), "event_id", "product_id")
    return pick(features.lookback(tx, as_of, 30), "window").unionByName(pick(features.lookback(tx, late, 30, fallback=True), "fallback"))


@query("f6_minimum_score", f"""WITH {CENTROIDS_SQL}
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10 AND score >= 0.25""")
def f6_minimum_score(spark, sf):
    index = table(spark, sf, "embeddings")
    queries = retrieval.centroids(index, "label").withColumnRenamed("label", "query_id")
    hits = retrieval.search(index, queries, 10)
    return hits.filter(F.col("score") >= 0.25).select("query_id", "vec_id", "rank")


@query("f7_state_filter", f"""WITH {ALERTS_SQL} SELECT alertname, series, active_at FROM alerts WHERE state = 'firing'""")
def f7_state_filter(spark, sf):
    from .monitoring import alert_states

    return alerts.by_state(alert_states(spark, sf), "firing").select("alertname", "series", "active_at")


@query("f8_topic_filter", f"""WITH {OFFSETS_SQL} SELECT topic, partition FROM ends WHERE NOT starts_with(topic, '_') AND topic IN ('click', 'view', '_internal')""")
def f8_topic_filter(spark, sf):
    return offsets.visible_topics(end_offsets(spark, sf), only=("click", "view", "_internal")).select("topic", "partition")


@query("f9_metric_keys", f"""WITH {RUNS_SQL} SELECT run_id, unnest(['mape', 'mse']) AS key, unnest([mape, mse]) AS value FROM runs""")
def f9_metric_keys(spark, sf):
    return registry.keep_metrics(runs(spark, sf), ("mape", "mse")).select("run_id", F.explode("metrics").alias("key", "value"))


@query("f10_run_selection", f"""WITH {RUNS_SQL}
SELECT run_id, start_time FROM runs WHERE experiment = 'exp_1-URGENT' AND status = 'FINISHED' AND start_time > TIMESTAMP '1999-01-01'""")
def f10_run_selection(spark, sf):
    return registry.new_runs(runs(spark, sf), "exp_1-URGENT", F.expr("TIMESTAMP_NTZ '1999-01-01'")).select("run_id", "start_time")


@query("f11_minimum_segment", """
SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang HAVING count(*) >= 5""")
def f11_minimum_segment(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count("*").alias("n")).filter(F.col("n") >= 5)


@query("f12_row_access", """
SELECT 'admin' AS role, c_custkey, c_acctbal FROM customer UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer WHERE c_custkey = 7""")
def f12_row_access(spark, sf):
    from ..operators.access import visible_rows

    customer = table(spark, sf, "customer")
    pick = lambda role: visible_rows(customer, role, "c_custkey", 7).select(F.lit(role).alias("role"), "c_custkey", "c_acctbal")
    return pick("admin").unionByName(pick("customer"))
