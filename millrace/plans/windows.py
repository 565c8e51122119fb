"""Window functions (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunking, forecast, metrics, profile, registry, retrieval
from ..operators.ordered import modal_value, top_per_group
from .catalog import query
from .features_sql import esum
from .monitoring_sql import ALERTS_SQL
from .retrieval_sql import CENTROIDS_SQL
from .tables import RUNS_SQL, TX_SQL, VERSIONS_SQL, events, model_versions, runs, samples, table, transactions


@query("w1_top_per_group", f"""WITH {TX_SQL} SELECT product_id, region, n FROM (SELECT product_id, region, count(*) AS n FROM tx GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, region) = 1""")
def w1_top_per_group(spark, sf):
    return modal_value(transactions(spark, sf), ["product_id"], "region")


@query("w2_latest_per_entity", """SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def w2_latest_per_entity(spark, sf):
    return top_per_group(events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).drop("props")


DAILY_SQL = f"""daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds, {esum('o_totalprice')} AS y, count(*) AS transaction_count FROM orders GROUP BY 1, 2)"""


def daily(spark, sf):
    return profile.daily_series(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "series"), "o_orderdate", F.col("o_totalprice"), ["series"])


@query("w3_sliding_sequences", f"""WITH {DAILY_SQL}
SELECT series, ds, y AS target, lag(y, 7) OVER w AS x1, lag(y, 1) OVER w AS x7 FROM daily WINDOW w AS (PARTITION BY series ORDER BY ds) QUALIFY lag(y, 7) OVER w IS NOT NULL""")
def w3_sliding_sequences(spark, sf):
    return forecast.sequences(daily(spark, sf), ["series"]).select(
        "series", "ds", F.col("y").alias("target"), F.col("x")[0].alias("x1"), F.col("x")[6].alias("x7"))


@query("w4_time_split", f"""WITH {DAILY_SQL} SELECT series, ds, y, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 7 THEN 'val' ELSE 'train' END AS split FROM daily""")
def w4_time_split(spark, sf):
    return forecast.time_split(daily(spark, sf), ["series"], 7).select("series", "ds", "y", "split")


@query("w6_context_budget", f"""WITH {CENTROIDS_SQL}, h AS (
  SELECT query_id, vec_id, text, length(text) AS len, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored JOIN documents ON vec_id = doc_id),
u AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h WHERE rank <= 5)
SELECT query_id, vec_id, rank, least(len, 2000 - CAST(used AS BIGINT)) AS kept FROM u WHERE used < 2000""")
def w6_context_budget(spark, sf):
    from .retrieval import document_hits

    return retrieval.context_budget(document_hits(spark, sf, 5)).select("query_id", "vec_id", "rank", F.length("content").cast("long").alias("kept"))


@query("w7_chunk_offsets", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(u)) AS BIGINT) + count(*) - 1 AS chars FROM p, LATERAL (SELECT unnest(parts) AS u) GROUP BY 1""")
def w7_chunk_offsets(spark, sf):
    """Paragraph ordinals and offsets: the last offset plus its length is the length of the text."""
    parts = chunking.paragraphs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", "\n")
    return parts.groupBy("doc_id").agg(
        (F.max("ordinal") + 1).cast("long").alias("paragraphs"), F.max(F.col("start_idx") + F.length("content")).cast("long").alias("chars"))


@query("w8_latest_run", f"""WITH {RUNS_SQL} SELECT experiment, run_id, start_time, mape FROM runs QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id) = 1""")
def w8_latest_run(spark, sf):
    return registry.latest_runs(runs(spark, sf)).select("experiment", "run_id", "start_time", F.col("metrics")["mape"].alias("mape"))


@query("w8_latest_version", f"""WITH {VERSIONS_SQL} SELECT model_name, stage, version, run_id FROM versions QUALIFY row_number() OVER (PARTITION BY model_name, stage ORDER BY version DESC) = 1""")
def w8_latest_version(spark, sf):
    return registry.latest_versions(model_versions(spark, sf)).select("model_name", "stage", "version", "run_id")


@query("w10_distribution_shift", f"""WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS step, count(value) AS n, sum(value) AS s, sum(value * value) AS ss FROM events GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER w AS bn, sum(s) OVER w AS bs, sum(ss) OVER w AS bss FROM h
  WINDOW w AS (PARTITION BY series ORDER BY step RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)),
d AS (SELECT series, step, abs(s / n - bs / bn) / nullif(sqrt(greatest(bss / bn - (bs / bn) * (bs / bn), 0)), 0) AS shift FROM b)
SELECT series, step, round(shift, 6) AS shift, coalesce(shift, 0) > 2 AS shifted FROM d""")
def w10_distribution_shift(spark, sf):
    return metrics.distribution_shift(samples(spark, sf)).withColumn("shift", F.round("shift", 6))


@query("w11_hold_state", f"WITH {ALERTS_SQL} SELECT alertname, series, ts, active_at, state FROM states")
def w11_hold_state(spark, sf):
    from .monitoring import alert_evaluations

    return alert_evaluations(spark, sf).select("alertname", "series", "ts", "active_at", "state")


@query("w12_counter_rate", """WITH d AS (SELECT event_type AS series, ts, event_id % 1000 AS c, lag(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT series, time_bucket(INTERVAL 5 MINUTE, ts) AS step, sum(CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END) AS delta FROM d GROUP BY 1, 2)
SELECT series, step, CAST(sum(delta) OVER w AS BIGINT) AS increase, round(CAST(sum(delta) OVER w AS BIGINT) / 3600.0, 9) AS rate FROM s
WINDOW w AS (PARTITION BY series ORDER BY step RANGE BETWEEN INTERVAL 55 MINUTE PRECEDING AND CURRENT ROW)""")
def w12_counter_rate(spark, sf):
    return metrics.increase(samples(spark, sf), 3600).withColumn("rate", F.round("rate", 9))


@query("w13_stalled_consumer", """WITH t AS (SELECT CASE WHEN event_type = 'signup' THEN '_internal' ELSE event_type END AS topic, CAST(user_id % 3 AS INTEGER) AS partition,
    date_trunc('hour', ts) AS step, max(CASE WHEN ts < TIMESTAMP '2024-01-20' THEN event_id + 1 END) AS c, max(event_id + 1) AS e FROM events GROUP BY 1, 2, 3),
g AS (SELECT topic, partition, unnest(generate_series((SELECT min(step) FROM t), (SELECT max(step) FROM t), INTERVAL 1 HOUR)) AS step FROM (SELECT DISTINCT topic, partition FROM t)),
f AS (SELECT g.topic, g.partition, g.step, max(c) OVER w AS committed, max(c) OVER (PARTITION BY g.topic, g.partition ORDER BY g.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
    max(e) OVER w AS e2 FROM g LEFT JOIN t ON g.topic = t.topic AND g.partition = t.partition AND g.step = t.step WINDOW w AS (PARTITION BY g.topic, g.partition ORDER BY g.step ROWS UNBOUNDED PRECEDING))
SELECT topic, partition, step, e2 - committed AS lag FROM f WHERE committed = previous AND e2 > committed""")
def w13_stalled_consumer(spark, sf):
    done = F.col("event_id") + 1
    topic = F.when(F.col("event_type") == "signup", "_internal").otherwise(F.col("event_type"))
    commits = events(spark, sf).select(
        topic.alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), "ts",
        F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20'"), done).alias("committed"), done.alias("end_offset"))
    return metrics.stalled_consumers(commits, ["topic", "partition"])


@query("w14_rollback_target", f"""WITH {VERSIONS_SQL}, cur AS (SELECT model_name, max(version) AS current_version FROM versions WHERE stage = 'Production' GROUP BY 1)
SELECT model_name, any_value(current_version) AS current_version, max(version) FILTER (version < current_version) AS target_version,
  CASE WHEN any_value(current_version) IS NULL THEN 'no production version' WHEN max(version) FILTER (version < current_version) IS NULL THEN 'no previous version' ELSE 'rollback' END AS reason
FROM versions LEFT JOIN cur USING (model_name) GROUP BY 1""")
def w14_rollback_target(spark, sf):
    return registry.rollback_targets(model_versions(spark, sf))


@query("w14_given_target", f"""WITH {VERSIONS_SQL}, cur AS (SELECT model_name, max(version) AS current_version FROM versions WHERE stage = 'Production' GROUP BY 1),
asked AS (SELECT model_name, CASE CAST(substr(model_name, 7) AS INTEGER) % 4 WHEN 0 THEN max(version) FILTER (stage = 'Production') WHEN 1 THEN min(version) WHEN 2 THEN 0 END AS requested
  FROM versions GROUP BY model_name),
f AS (SELECT model_name, any_value(current_version) AS c, any_value(requested) AS r, max(version) FILTER (version < current_version) AS older, bool_or(coalesce(version = requested, false)) AS known
  FROM versions LEFT JOIN cur USING (model_name) LEFT JOIN asked USING (model_name) GROUP BY 1),
d AS (SELECT *, CASE WHEN c IS NULL THEN 'no production version' WHEN r IS NULL AND older IS NULL THEN 'no previous version' WHEN r = c THEN 'already in production'
  WHEN r IS NOT NULL AND NOT known THEN 'unknown version' ELSE 'rollback' END AS reason FROM f)
SELECT model_name, c AS current_version, CASE WHEN reason = 'rollback' THEN coalesce(r, older) END AS target_version, reason FROM d""")
def w14_given_target(spark, sf):
    """Given versions by turns: the one in production, the first one, one that does not exist, none."""
    versions = model_versions(spark, sf)
    turn = F.substring("model_name", 7, 10).cast("int") % 4
    asked = versions.groupBy("model_name").agg(F.min("version").alias("first"), F.max(F.when(F.col("stage") == "Production", F.col("version"))).alias("live"))
    requested = F.when(turn == 0, F.col("live")).when(turn == 1, F.col("first")).when(turn == 2, F.lit(0))
    return registry.rollback_targets(versions, asked.select("model_name", requested.alias("requested")))


@query("w15_share_of_total", """SELECT event_type, count(*) AS n, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS share FROM events GROUP BY 1""")
def w15_share_of_total(spark, sf):
    return profile.with_share(events(spark, sf), "event_type")
