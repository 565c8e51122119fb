"""Aggregations (A1-A18, A27-A36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import access, churn, events as E
from ..operators import features, metrics, offsets, profile, quality, registry
from ..operators.ordered import index_percentiles, modal_value, quantiles
from .catalog import query
from .features_sql import PRODUCT_FEATURES_SQL, USER_FEATURES_SQL, eavg, esum, r2
from .joins import LAG_SQL, _BASELINE_SQL
from .monitoring_sql import ALERTS_SQL
from .tables import (OFFSETS_SQL, RAW_SQL, RUNS_SQL, TX_SQL, audit_log, committed_offsets, end_offsets, events, model_versions,
                     raw_transactions, runs, table, transactions)


def _as_of(spark, sf):
    return features.latest(table(spark, sf, "orders"), "o_orderdate")


@query("a1_user_features", USER_FEATURES_SQL)
def a1_user_features(spark, sf):
    return features.user_features(transactions(spark, sf), _as_of(spark, sf)).drop("event_timestamp", "created_timestamp")


@query("a2_product_features", PRODUCT_FEATURES_SQL)
def a2_product_features(spark, sf):
    return features.product_features(transactions(spark, sf), _as_of(spark, sf)).drop("event_timestamp", "created_timestamp")


@query("a3_modal_value", f"""WITH {TX_SQL} SELECT user_id, channel, n FROM (SELECT user_id, channel, count(*) AS n FROM tx GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, channel) = 1""")
def a3_modal_value(spark, sf):
    return modal_value(transactions(spark, sf), ["user_id"], "channel")


@query("a4_daily_series", f"""WITH {TX_SQL}
SELECT CAST(event_timestamp AS DATE) AS ds, {esum('total_amount')} AS y, count(*) AS transaction_count FROM tx GROUP BY 1 ORDER BY 1""")
def a4_daily_series(spark, sf):
    return profile.daily_series(transactions(spark, sf), "event_timestamp", F.col("total_amount")).orderBy("ds")


@query("a5_kpi_row", f"""WITH {TX_SQL} SELECT count(*) AS total_transactions, {esum('total_amount')} AS total_revenue, {eavg('total_amount')} AS avg_revenue,
  quantile_cont(total_amount, 0.5) AS median_revenue, max(total_amount) AS max_revenue, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT product_id) AS unique_products, count(DISTINCT location) AS unique_locations, CAST(sum(quantity) AS DOUBLE) / count(quantity) AS avg_items,
  min(event_timestamp) AS first_event, max(event_timestamp) AS last_event, datesub('day', min(event_timestamp), max(event_timestamp)) AS span_days FROM tx""")
def a5_kpi_row(spark, sf):
    return profile.kpi_row(transactions(spark, sf))


@query("a6_channel_breakdown", f"""WITH {TX_SQL} SELECT channel, count(*) AS transactions, {esum('total_amount')} AS revenue, {eavg('total_amount')} AS avg_revenue,
  count(*) / CAST((SELECT count(*) FROM tx) AS DOUBLE) * 100 AS share_pct FROM tx GROUP BY 1""")
def a6_channel_breakdown(spark, sf):
    return profile.breakdown(transactions(spark, sf), "channel")


@query("a7_daily_trends", f"""WITH {TX_SQL} SELECT CAST(event_timestamp AS DATE) AS date, count(*) AS transactions, {esum('total_amount')} AS revenue,
  count(DISTINCT user_id) AS users FROM tx GROUP BY 1""")
def a7_daily_trends(spark, sf):
    return profile.daily_trends(transactions(spark, sf))


@query("a8_value_counts", """SELECT 'hour' AS what, CAST(hour(ts) AS VARCHAR) AS v, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'type', event_type, count(*) FROM events GROUP BY 2""")
def a8_value_counts(spark, sf):
    e = events(spark, sf)
    count = lambda c, what: profile.value_counts(e, c, "v").withColumn("what", F.lit(what))
    return count(F.hour("ts").cast("string"), "hour").unionByName(count(F.col("event_type"), "type"))


@query("a9_histogram", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def a9_histogram(spark, sf):
    return profile.histogram(events(spark, sf), "value", 50)


@query("a10_describe", f"""SELECT count(value) AS count, {eavg('value')} AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM events""")
def a10_describe(spark, sf):
    return profile.describe(events(spark, sf), "value").withColumn("std", F.round("std", 6))


_CORR = ("price", "quantity", "total_amount")


@query("a11_correlation", f"WITH {TX_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM tx" for a in _CORR for b in _CORR))
def a11_correlation(spark, sf):
    return profile.correlations(transactions(spark, sf), list(_CORR)).withColumn("r", F.round("r", 6))


_RAW_COLUMNS = ("id", "timestamp", "user_id", "product_id", "price", "quantity", "location")


@query("a12_missing_share", f"WITH {RAW_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL) / CAST(count(*) AS DOUBLE) * 100 AS missing_pct FROM raw""" for c in _RAW_COLUMNS))
def a12_missing_share(spark, sf):
    return profile.missing_share(raw_transactions(spark, sf), list(_RAW_COLUMNS))


def behaviour_sql(source: str, ref: str) -> str:
    return f"""SELECT user_id, count(event_id) AS transaction_count, {esum('total_amount')} AS total_revenue, {eavg('total_amount')} AS avg_revenue,
  round(coalesce(stddev_samp(total_amount), 0), 4) AS std_revenue, {eavg('price')} AS avg_price, max(price) AS max_price, min(price) AS min_price,
  CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(quantity) AS DOUBLE) / count(quantity) AS avg_quantity,
  datesub('day', min(event_timestamp), {ref}) AS days_since_first, datesub('day', max(event_timestamp), {ref}) AS days_since_last,
  datesub('day', min(event_timestamp), {ref}) / CAST(count(event_id) AS DOUBLE) AS avg_days_between,
  (SELECT c.channel FROM (SELECT channel, count(*) AS n FROM {source} i WHERE i.user_id = o.user_id GROUP BY 1) c ORDER BY c.n DESC, c.channel LIMIT 1) AS primary_channel
  FROM {source} o GROUP BY user_id"""


@query("a13_user_behavior", f"""WITH {TX_SQL}, t AS MATERIALIZED (SELECT * FROM tx) {behaviour_sql('t', '(SELECT max(event_timestamp) FROM t)')}""")
def a13_user_behavior(spark, sf):
    tx = transactions(spark, sf)
    return churn.user_behavior(tx, features.latest(tx, "event_timestamp")).withColumn("std_revenue", F.round("std_revenue", 4))


@query("a14_quantile_thresholds", f"""WITH {TX_SQL}, u AS (SELECT user_id, {esum('total_amount')} AS revenue FROM tx GROUP BY 1)
SELECT round(quantile_cont(revenue, 0.35), 6) AS q35, round(quantile_cont(revenue, 0.5), 6) AS q50, round(quantile_cont(revenue, 0.65), 6) AS q65 FROM u""")
def a14_quantile_thresholds(spark, sf):
    per_user = transactions(spark, sf).groupBy("user_id").agg(S.stable_sum(F.col("total_amount")).alias("revenue"))
    cuts = quantiles(per_user, "revenue", {"q35": 0.35, "q50": 0.5, "q65": 0.65})
    return cuts.select(*[F.round(c, 6).alias(c) for c in cuts.columns])


@query("a15_value_cohorts", f"""WITH {TX_SQL}, u AS (SELECT user_id, {esum('total_amount')} AS total_revenue FROM tx GROUP BY 1),
q AS (SELECT quantile_cont(total_revenue, 1.0 / 3) AS a, quantile_cont(total_revenue, 2.0 / 3) AS b FROM u)
SELECT user_id, total_revenue, CASE WHEN total_revenue <= a THEN 'Low Value' WHEN total_revenue <= b THEN 'Medium Value' ELSE 'High Value' END AS user_cohort FROM u, q""")
def a15_value_cohorts(spark, sf):
    per_user = transactions(spark, sf).groupBy("user_id").agg(S.stable_sum(F.col("total_amount")).alias("total_revenue"))
    return churn.value_cohorts(per_user, "total_revenue")


@query("a16_churn_labels_true", f"""WITH {TX_SQL}, t AS MATERIALIZED (SELECT * FROM tx), m AS (SELECT max(event_timestamp) - INTERVAL 180 DAY AS cutoff FROM t),
early AS MATERIALIZED (SELECT t.* FROM t, m WHERE event_timestamp < cutoff), f AS ({behaviour_sql('early', '(SELECT cutoff FROM m)')})
SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM t, m WHERE t.user_id = f.user_id AND event_timestamp >= cutoff) THEN 0 ELSE 1 END AS churned FROM f""")
def a16_churn_labels_true(spark, sf):
    return churn.churn_labels(transactions(spark, sf), 180).withColumn("std_revenue", F.round("std_revenue", 4))


@query("a16_churn_labels_rule", f"""WITH {TX_SQL}, t AS MATERIALIZED (SELECT * FROM tx), f AS ({behaviour_sql('t', '(SELECT max(event_timestamp) FROM t)')}),
q AS (SELECT quantile_cont(total_revenue, 0.35) AS lo, quantile_cont(total_revenue, 0.5) AS mid, quantile_cont(days_since_last, 0.65) AS late FROM f)
SELECT f.*, CASE WHEN total_revenue < lo OR (total_revenue < mid AND days_since_last > late) THEN 1 ELSE 0 END AS churned FROM f, q""")
def a16_churn_labels_rule(spark, sf):
    """A window of one day has almost no returning users, so the rule applies."""
    return churn.churn_labels(transactions(spark, sf), 1).withColumn("std_revenue", F.round("std_revenue", 4))


def _dq_sql() -> str:
    checks = [("row_count_check", "Verify row count > 0", "> 0", "count(*)", "> 0")]
    checks += [(f"null_check_{c}", f"Verify {c} has no nulls", "0", f'count(*) FILTER ("{c}" IS NULL)', "= 0") for c in _RAW_COLUMNS]
    checks += [("price_range_check", "Verify all prices are non-negative", "0", "count(*) FILTER (price < 0)", "= 0"),
               ("quantity_check", "Verify all quantities are >= 1", "0", "count(*) FILTER (quantity < 1)", "= 0")]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{d}' AS description, '{e}' AS expected, {a} AS actual, {a} {p} AS passed FROM raw" for n, d, e, a, p in checks)


@query("a17_quality_report", f"WITH {RAW_SQL} {_dq_sql()}")
def a17_quality_report(spark, sf):
    return quality.quality_report(raw_transactions(spark, sf), _RAW_COLUMNS)


@query("a18_run_statistics", f"""WITH {RAW_SQL} SELECT (SELECT count(*) FROM raw) AS input_count, count(*) AS output_count,
  (SELECT count(*) FROM raw) - count(*) AS invalid_count, count(DISTINCT strftime(parsed_ts, '%Y-%m-%d')) AS partitions,
  (SELECT round(count(*) / CAST(datesub('second', min(parsed_ts), max(parsed_ts)) AS DOUBLE), 9) FROM raw) AS records_per_second FROM valid""")
def a18_run_statistics(spark, sf):
    """The records' own time span stands for the duration, so that the rate can be repeated."""
    time = S.iso_timestamp(F.col("timestamp"))
    span = F.timestamp_diff("SECOND", F.min(time), F.max(time))
    out = profile.run_statistics(raw_transactions(spark, sf), E.is_complete(), S.partition_day(time), span)
    return out.withColumn("records_per_second", F.round("records_per_second", 9))


@query("a27_live_kpis", f"""WITH m AS (SELECT max(ts) AS t FROM events), newest AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT 'total_events' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events
UNION ALL SELECT 'events_1m', count(*) FROM events, m WHERE ts > t - INTERVAL 1 MINUTE
UNION ALL SELECT 'events_5m', count(*) FROM events, m WHERE ts > t - INTERVAL 5 MINUTE
UNION ALL SELECT 'events_1h', count(*) FROM events, m WHERE ts > t - INTERVAL 60 MINUTE
UNION ALL SELECT 'events_per_sec', count(*) / 60.0 FROM events, m WHERE ts > t - INTERVAL 1 MINUTE
UNION ALL SELECT 'avg_price', {eavg('nullif(value, 0)')} FROM newest
UNION ALL SELECT 'type_' || event_type, count(*) FROM newest GROUP BY event_type""")
def a27_live_kpis(spark, sf):
    e = events(spark, sf)
    return profile.live_kpis(e, features.latest(e, "ts"))


@query("a28_consumer_lag", f"""WITH {LAG_SQL} SELECT group_id, topic, CAST(sum(lag) AS BIGINT) AS total_lag, count(*) AS partition_count FROM lag
GROUP BY GROUPING SETS ((group_id, topic), (group_id))""")
def a28_consumer_lag(spark, sf):
    return offsets.group_lag(offsets.partition_lag(committed_offsets(spark, sf), end_offsets(spark, sf)))


@query("a29_topic_stats", f"""WITH {OFFSETS_SQL} SELECT topic, CAST(sum(end_offset - begin_offset) AS BIGINT) AS messages, count(*) AS partitions FROM ends GROUP BY 1""")
def a29_topic_stats(spark, sf):
    return offsets.topic_stats(end_offsets(spark, sf))


@query("a30_latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99,
  count(*) FILTER (value <= 50) AS successes, count(*) FILTER (value > 50) AS errors FROM r GROUP BY 1""")
def a30_latency_percentiles(spark, sf):
    e = events(spark, sf)
    counts = e.groupBy("event_type").agg(
        F.count(F.when(F.col("value") <= 50, 1)).alias("successes"), F.count(F.when(F.col("value") > 50, 1)).alias("errors"))
    return index_percentiles(e, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"]).join(counts, "event_type")


@query("a31_error_ratio", """SELECT user_id, count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) AS error_ratio,
  count(*) FILTER (event_type <> 'error') / CAST(count(*) AS DOUBLE) AS success_rate FROM events GROUP BY 1""")
def a31_error_ratio(spark, sf):
    return metrics.error_ratio(events(spark, sf), F.col("event_type") == "error", ["user_id"])


@query("a32_promotion_decision", f"""WITH {_BASELINE_SQL}, c AS (
  SELECT run_id, runs.model_name, b_mape, CASE WHEN b_mape > 0 THEN (b_mape - mape) / b_mape * 100 END AS i_mape,
    CASE WHEN b_mse > 0 THEN (b_mse - mse) / b_mse * 100 END AS i_mse FROM runs LEFT JOIN base USING (model_name) WHERE status = 'FINISHED')
SELECT run_id, model_name, b_mape IS NULL OR coalesce(i_mape >= 5, false) OR coalesce(i_mse >= 10, false) AS promote,
  CASE WHEN b_mape IS NULL THEN 'No production baseline - first model' WHEN coalesce(i_mape >= 5, false) OR coalesce(i_mse >= 10, false) THEN
    concat_ws('; ', CASE WHEN i_mape >= 5 THEN format('mape improved by {{:.2f}}% (threshold: 5.0%)', {r2('i_mape')}) END,
      CASE WHEN i_mse >= 10 THEN format('mse reduced by {{:.2f}}% (threshold: 10.0%)', {r2('i_mse')}) END) ELSE 'No significant improvement' END AS reason FROM c""")
def a32_promotion_decision(spark, sf):
    all_runs = runs(spark, sf)
    base = registry.production_baseline(model_versions(spark, sf), all_runs)
    return registry.promotion_decisions(all_runs.filter("status = 'FINISHED'"), base)


@query("a33_best_model", f"""WITH {RUNS_SQL} SELECT model_name, run_id, mape FROM runs QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY mape, run_id) = 1""")
def a33_best_model(spark, sf):
    scored = runs(spark, sf).withColumn("mape", F.col("metrics")["mape"])
    return registry.best_by(scored, ["model_name"], "run_id", "mape").select("model_name", "run_id", "mape")


@query("a34_pii_access", """SELECT event_id AS query_id, 'analyst_' || (user_id % 10) AS user_name, 'SELECT ' || event_type AS query_text FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND event_type IN ('purchase', 'signup')""")
def a34_pii_access(spark, sf):
    audit = audit_log(spark, sf)
    return access.pii_access(audit, features.latest(audit, "timestamp")).select("query_id", "user_name", "query_text")


@query("a34_unusual_access", """SELECT 'analyst_' || (user_id % 10) AS user_name, count(*) AS query_count, count(DISTINCT event_type) AS tables_accessed FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 240 HOUR GROUP BY 1 HAVING count(*) > 100""")
def a34_unusual_access(spark, sf):
    audit = audit_log(spark, sf)
    return access.unusual_access(audit, features.latest(audit, "timestamp"), hours=240)


@query("a35_alert_counts", f"""WITH {ALERTS_SQL} SELECT count(*) FILTER (state = 'firing') AS firing, count(*) FILTER (state = 'pending') AS pending, count(*) AS total FROM alerts""")
def a35_alert_counts(spark, sf):
    from .monitoring import alert_states

    state = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return alert_states(spark, sf).agg(state("firing"), state("pending"), F.count("*").alias("total"))


@query("a36_split_facts", """SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, CAST(sum(quality) AS DOUBLE) / count(*) AS rate FROM labels GROUP BY 1""")
def a36_split_facts(spark, sf):
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    return table(spark, sf, "labels").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.avg("quality").alias("rate"))
