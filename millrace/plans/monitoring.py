"""Metric series, alert rules, drift and decisions (L, M14-M16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts, drift, features, metrics
from ..operators.offsets import under_replicated
from ..operators.ordered import index_percentiles
from .catalog import query
from .evaluation import PRED_SQL, predictions
from .features_sql import rnd
from .joins import _SEVERE_SQL, severe
from .monitoring_sql import ALERTS_SQL
from .tables import events, samples, table


def metric_frame(spark, sf):
    """Hourly metrics per event type, long form: what one aggregation of the events gives, and the shift, replica and consumer metrics."""
    e, v = events(spark, sf), F.col("value")
    hourly = e.groupBy(metrics.step_of("ts", 3600).alias("ts"), F.col("event_type").alias("series")).agg(
        F.count("*").cast("double").alias("n"), F.max(v).alias("mx"), F.count(F.when(v > 40, 1)).alias("err"), F.count(F.when(v < 15, 1)).alias("failed"),
        S.stable_avg(v).alias("mean"), metrics.cumulative_counts(v / 50).alias("latency"), metrics.cumulative_counts(v, metrics.AGENT_BUCKETS).alias("agent"),
        F.max(F.when(v > 99, F.col("ts"))).alias("trained"), F.max(F.when(F.col("event_id") % 4 == 0, F.col("ts"))).alias("synced"))
    hourly = hourly.withColumns({"trained_age": metrics.age_at_step("trained", 3600), "synced_age": metrics.age_at_step("synced", 3600)})
    off = F.abs(F.col("mean") - 50) / 100
    values = {
        "prediction_p99_seconds": metrics.quantile_of_counts("latency", 0.99), "prediction_error_ratio": F.col("err") / F.col("n"),
        "model_drift_score": off, "feature_drift_score": off, "consumer_lag": F.col("n") * 3000, "up": F.when(F.col("n") < 2, 0.0).otherwise(1.0),
        "memory_ratio": F.col("mx") / 100, "restarts_1h": F.col("n"), "training_data_age_seconds": F.col("trained_age"),
        "feature_lag_seconds": F.col("synced_age"), "agent_failure_ratio": F.col("failed") / F.col("n"),
        "agent_p95_seconds": metrics.quantile_of_counts("agent", 0.95, metrics.AGENT_BUCKETS),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in values.items()])
    frame = hourly.select("series", "ts", F.inline(pairs))

    def named(metric, df, value):
        return df.select("series", F.col("step").alias("ts"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    shift = metrics.distribution_shift(samples(spark, sf))
    logs = e.select(F.col("event_type").alias("series"), (F.col("user_id") % 2).alias("partition"), (F.col("event_id") % 2).alias("replica"), "ts",
                    (F.col("event_id") + 1).alias("end_offset"))
    thin = under_replicated(logs, ["series"], "partition", "replica", partitions=2, replicas=2)
    commits = logs.withColumn("committed", F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20'"), F.col("end_offset")))
    stalled = metrics.stalled_consumers(commits, ["series", "partition"]).groupBy("series", "step").agg(F.count("*").alias("n"))
    frame = (frame.unionByName(named("prediction_shift", shift, F.round("shift", 6))).unionByName(named("under_replicated_partitions", thin, F.col("thin")))
             .unionByName(named("consumer_stalled", stalled, F.col("n"))))
    job = F.when(F.col("series").isin("purchase", "view"), "predict-service").when(F.col("series") == "click", "rag-service").otherwise("mlflow")
    return frame.filter("value is not null").select("series", job.alias("job"), "ts", "metric", "value")


def alert_evaluations(spark, sf):
    return alerts.evaluations(metric_frame(spark, sf))


def alert_states(spark, sf):
    return alerts.alert_instances(alert_evaluations(spark, sf))


@query("l1_instant_value", """SELECT event_type AS series, ts, value AS gauge FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 10:00:00'
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""")
def l1_instant_value(spark, sf):
    return metrics.instant(samples(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'"), 7200).select("series", "ts", "gauge")


@query("l2_range_values", """WITH g AS (SELECT series, unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 10 MINUTE)) AS step FROM (SELECT DISTINCT event_type AS series FROM events))
SELECT g.series, step, CASE WHEN step - ts <= INTERVAL 1 HOUR THEN value END AS gauge FROM g ASOF LEFT JOIN events e ON g.series = e.event_type AND g.step >= e.ts""")
def l2_range_values(spark, sf):
    at = lambda d: F.expr(f"TIMESTAMP_NTZ '{d}'")
    return metrics.range_grid(samples(spark, sf), at("2024-01-10"), at("2024-01-12"), 600, "gauge", staleness_seconds=3600)


_BUCKETS = metrics.DURATION_BUCKETS


@query("l3_histogram_quantile", f"""WITH b AS (SELECT event_type AS series, le, lo, count(*) FILTER (value / 50 <= le) AS cum, count(*) FILTER (value / 50 <= lo) AS before, count(value) AS n
  FROM events, (VALUES {', '.join(f'({hi}::DOUBLE, {lo}::DOUBLE)' for lo, hi in zip((-1.0,) + _BUCKETS[:-1], _BUCKETS))}) v(le, lo) GROUP BY 1, 2, 3),
h AS (SELECT series, n, min(le) FILTER (cum >= CAST(0.95 AS DOUBLE) * n) AS le FROM b GROUP BY 1, 2)
SELECT h.series, CASE WHEN h.le IS NULL THEN {_BUCKETS[-1]} ELSE greatest(lo, 0) + (h.le - greatest(lo, 0)) * ((CAST(0.95 AS DOUBLE) * h.n - before) / (cum - before)) END AS quantile
FROM h LEFT JOIN b ON h.series = b.series AND h.le = b.le""")
def l3_histogram_quantile(spark, sf):
    durations = events(spark, sf).select(F.col("event_type").alias("series"), (F.col("value") / 50).alias("seconds"))
    return metrics.histogram_quantile(durations, "seconds", 0.95, ["series"])


_EDGES = [*_BUCKETS, float("inf")]


def bucket_counters(spark, sf):
    """Hourly scrapes of cumulative bucket counters: two instances a series, restarted every five days; one does not expose an edge."""
    edges = F.array(*[F.lit(x) for x in _EDGES])
    seen = events(spark, sf).select(F.col("event_type").alias("series"), (F.col("user_id") % 2).cast("int").alias("instance"),
                                    metrics.step_of("ts", 3600).alias("ts"), (F.col("value") / 50).alias("seconds"), F.explode(edges).alias("le"))
    hourly = seen.groupBy("series", "instance", "le", "ts").agg(F.count(F.when(F.col("seconds") <= F.col("le"), 1)).alias("n"))
    life = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (5 * 86400))
    since = Window.partitionBy("series", "instance", "le", life).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # a row an hour
    counters = hourly.withColumns({"counter": F.sum("n").over(since), "seq": F.lit(0)}).drop("n")
    return counters.filter((F.col("instance") != 1) | (F.col("le") != 0.5))


_L3_SQL = f"""h AS (SELECT event_type AS series, CAST(user_id % 2 AS INTEGER) AS instance, date_trunc('hour', ts) AS ts, le, count(*) FILTER (value / 50 <= le) AS n
  FROM events, (SELECT unnest([{', '.join(f'{x}::DOUBLE' if x != float('inf') else "'inf'::DOUBLE" for x in _EDGES)}]) AS le) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY series, instance, le, floor(epoch(ts) / 432000) ORDER BY ts) AS counter FROM h WHERE instance <> 1 OR le <> 0.5),
d AS (SELECT *, CASE WHEN lag(counter) OVER w IS NULL THEN 0 WHEN counter < lag(counter) OVER w THEN counter ELSE counter - lag(counter) OVER w END AS delta
  FROM c WINDOW w AS (PARTITION BY series, instance, le ORDER BY ts)),
i AS (SELECT series, instance, le, ts, sum(delta) OVER (PARTITION BY series, instance, le ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW) AS inc FROM d),
r AS (SELECT series, ts, le, CAST(sum(inc) AS DOUBLE) / 21600 AS rate FROM i GROUP BY ALL),
m AS (SELECT *, max(rate) OVER (PARTITION BY series, ts ORDER BY le) AS cum, CAST(0.95 AS DOUBLE) * max(rate) OVER (PARTITION BY series, ts) AS rank FROM r),
p AS (SELECT *, coalesce(lag(cum) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0) AS lower FROM m WINDOW w AS (PARTITION BY series, ts ORDER BY le)),
f AS (SELECT * FROM p WHERE cum >= rank QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY le) = 1)"""


@query("l3_bucket_counters", f"""WITH {_L3_SQL} SELECT series, ts AS step, round(CASE WHEN rank = 0 THEN NULL WHEN isinf(le) THEN lower
  ELSE lower + (le - lower) * CASE WHEN cum = before THEN 0 ELSE (rank - before) / (cum - before) END END, 9) AS quantile FROM f""")
def l3_bucket_counters(spark, sf):
    """The 0.95 quantile of request durations per series and hour, from six-hour rates of bucket counters."""
    rates = metrics.bucket_rates(bucket_counters(spark, sf), 21600, 3600, ["series"], ["instance"])
    return metrics.quantile_of_rates(rates, 0.95, ["series", "step"]).withColumn("quantile", F.round("quantile", 9))


@query("l4_threshold_alerts", f"WITH {ALERTS_SQL} SELECT alertname, series, job, severity, team, active_at, last_ts, value, state FROM alerts")
def l4_threshold_alerts(spark, sf):
    return alert_states(spark, sf)


@query("l5_freshness", """SELECT 'events' AS source, max(ts) AS last_update, datesub('second', max(ts), TIMESTAMP '2024-02-01') AS age_seconds FROM events
UNION ALL SELECT 'orders', max(o_orderdate), datesub('second', max(o_orderdate), TIMESTAMP '2024-02-01') FROM orders
UNION ALL SELECT 'lineitem', max(l_shipdate), datesub('second', max(l_shipdate), TIMESTAMP '2024-02-01') FROM lineitem""")
def l5_freshness(spark, sf):
    as_of = F.expr("TIMESTAMP_NTZ '2024-02-01'")
    out = metrics.freshness(events(spark, sf), "events", "ts", as_of)
    for name, ts in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        out = out.unionByName(metrics.freshness(table(spark, sf, name), name, ts, as_of))
    return out


@query("l6_notifications", f"""WITH {ALERTS_SQL}, s AS {_SEVERE_SQL}, k AS (
  SELECT * FROM s WHERE NOT (severity = 'warning' AND EXISTS (SELECT 1 FROM s c WHERE c.severity = 'critical' AND c.alertname = s.alertname AND c.job = s.job AND c.ts = s.ts))
  AND NOT (alertname <> 'ServiceDown' AND EXISTS (SELECT 1 FROM s d WHERE d.alertname = 'ServiceDown' AND d.job = s.job AND d.ts = s.ts))),
g AS (SELECT alertname, job, severity, ts, count(*) AS n FROM k GROUP BY ALL),
e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY alertname, job, severity ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY alertname, job, severity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT *, CAST(floor((epoch(ts) - epoch(min(ts) OVER (PARTITION BY alertname, job, severity, run))) / 14400) AS BIGINT) AS slot FROM r)
SELECT alertname, job, severity, slot, min(ts) AS sent_at, max(n) AS alerts FROM f GROUP BY alertname, job, severity, run, slot""")
def l6_notifications(spark, sf):
    return alerts.notifications(alerts.inhibit(severe(spark, sf)))


@query("l7_panels", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def l7_panels(spark, sf):
    return metrics.panel_counts(events(spark, sf), "ts", "event_type")


_COUNTER_SQL = """d AS (SELECT event_type AS series, ts, event_id % 1000 AS c, lag(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT series, ts, CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END AS delta FROM d)"""


@query("l7_rate_panels", f"""WITH {_COUNTER_SQL}, s AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS step, CAST(sum(delta) AS BIGINT) AS n,
  CAST(coalesce(sum(delta) FILTER (series = 'error'), 0) AS BIGINT) AS bad FROM g GROUP BY 1)
SELECT step, round(n / 300.0, 9) AS request_rate, round(bad / CAST(nullif(n, 0) AS DOUBLE), 9) AS error_rate FROM s""")
def l7_rate_panels(spark, sf):
    out = metrics.rate_panels(samples(spark, sf), F.col("series") == "error")
    return out.select("step", F.round("request_rate", 9).alias("request_rate"), F.round("error_rate", 9).alias("error_rate"))


@query("l7_actions_24h", f"""WITH {_COUNTER_SQL}, m AS (SELECT max(ts) AS t FROM events)
SELECT series, CAST(coalesce(sum(delta) FILTER (ts > t - INTERVAL 1 DAY), 0) AS BIGINT) AS increase FROM g, m GROUP BY 1""")
def l7_actions_24h(spark, sf):
    rows = samples(spark, sf)
    return metrics.latest_increase(rows, rows.agg(F.max("ts")).scalar())


@query("l8_report_text", f"""WITH {ALERTS_SQL} SELECT alertname, '**Severity:** ' || any_value(severity) || chr(10) || '**Firing:** ' || count(*) FILTER (state = 'firing') AS message FROM alerts GROUP BY 1""")
def l8_report_text(spark, sf):
    counted = alert_states(spark, sf).groupBy("alertname").agg(
        F.first("severity").alias("severity"), F.count(F.when(F.col("state") == "firing", 1)).cast("string").alias("firing"))
    section = lambda t, c: F.struct(F.lit(t).alias("title"), F.col(c).alias("value"))
    return counted.select("alertname", alerts.report_message(F.array(section("Severity", "severity"), section("Firing", "firing"))).alias("message"))


HALF = "2024-01-15"
_PSI_SQL = f"""ref AS (SELECT event_type AS feature, value FROM events WHERE ts < TIMESTAMP '{HALF}'), cur AS (SELECT event_type AS feature, value FROM events WHERE ts >= TIMESTAMP '{HALF}'),
e AS (SELECT feature, {', '.join(f'quantile_cont(value, {i / 10}) AS c{i}' for i in range(1, 10))} FROM ref GROUP BY 1),
rb AS (SELECT feature, {' + '.join(f'CAST(value > c{i} AS INTEGER)' for i in range(1, 10))} AS bin, count(*) AS n FROM ref JOIN e USING (feature) GROUP BY 1, 2),
cb AS (SELECT feature, {' + '.join(f'CAST(value > c{i} AS INTEGER)' for i in range(1, 10))} AS bin, count(*) AS n FROM cur JOIN e USING (feature) GROUP BY 1, 2),
q AS (SELECT feature, bin, n / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS q FROM rb), p AS (SELECT feature, bin, n / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS p FROM cb),
j AS (SELECT feature, greatest(coalesce(p, 0), 0.0001) AS p, greatest(coalesce(q, 0), 0.0001) AS q FROM q FULL JOIN p USING (feature, bin)),
psi AS (SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM j GROUP BY 1)"""


def drift_scores(spark, sf):
    half = F.expr(f"TIMESTAMP_NTZ '{HALF}'")
    e = events(spark, sf).select(F.col("event_type").alias("feature"), "value", "ts")
    return drift.psi(e.filter(F.col("ts") < half), e.filter(F.col("ts") >= half), "value", ["feature"])


_LEVEL = "CASE WHEN psi > 0.2 THEN 'critical' WHEN psi > 0.1 THEN 'drift' WHEN psi > 0.08 THEN 'warning' ELSE 'ok' END"


@query("m14_drift_psi", f"WITH {_PSI_SQL} SELECT feature, round(psi, 9) AS psi, {_LEVEL} AS level, psi > 0.15 AS feature_drift FROM psi")
def m14_drift_psi(spark, sf):
    s = F.col("psi")
    return drift_scores(spark, sf).select(
        "feature", F.round("psi", 9).alias("psi"), drift.drift_level(s).alias("level"), (s > drift.FEATURE_DRIFT).alias("feature_drift"))


_DRIFT_SQL = """d AS (SELECT event_type AS feature, time_bucket(INTERVAL 6 HOUR, ts) AS ts, abs(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) - 50) / 100 AS drift FROM events GROUP BY 1, 2)"""


def drift_evaluations(spark, sf):
    """Four evaluations a day."""
    return events(spark, sf).groupBy(F.col("event_type").alias("feature"), metrics.step_of("ts", 6 * 3600).alias("ts")).agg(
        (F.abs(S.stable_avg(F.col("value")) - 50) / 100).alias("drift"))


@query("m15_retrain_decision", f"""WITH RECURSIVE {_DRIFT_SQL}, a AS (SELECT *, CASE WHEN drift > 0.1 THEN 'retrain' ELSE 'skip' END AS action FROM d),
kept AS (SELECT feature, min(ts) AS ts FROM a WHERE action = 'retrain' GROUP BY 1
  UNION ALL SELECT k.feature, min(a.ts) FROM kept k JOIN a ON a.feature = k.feature AND a.action = 'retrain' AND a.ts >= k.ts + INTERVAL 24 HOUR GROUP BY 1),
c AS (SELECT a.*, kept.ts IS NOT NULL AS free, coalesce(sum(CAST(kept.ts IS NOT NULL AS INTEGER)) OVER (PARTITION BY CAST(a.ts AS DATE) ORDER BY a.ts, a.feature
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM a LEFT JOIN kept ON a.feature = kept.feature AND a.ts = kept.ts)
SELECT feature, ts, action, format('Drift {{:.4f}} {{}} 0.1', {rnd('drift', 4)}, CASE WHEN drift > 0.1 THEN '>' ELSE '<=' END) AS reason,
  action = 'retrain' AND NOT free AS in_cooldown, CAST(taken AS BIGINT) AS granted_today, free AND taken < 2 AS allowed FROM c""")
def m15_retrain_decision(spark, sf):
    decided = drift.retrain_decision(drift_evaluations(spark, sf), "drift")
    return drift.apply_limits(decided, ["feature"], "ts").select("feature", "ts", "action", "reason", "in_cooldown", "granted_today", "allowed")


@query("m15_metric_gates", """SELECT 'run_' || o_orderkey AS run_id, 1 / (1 + o_totalprice / 262144) >= 0.85 AS accuracy_ok, o_totalprice / 16384 <= 15 AS mape_ok,
  1 / (1 + o_totalprice / 262144) >= 0.85 AND o_totalprice / 16384 <= 15 AS passed FROM orders""")
def m15_metric_gates(spark, sf):
    from .tables import runs

    flat = runs(spark, sf).select("run_id", F.col("metrics")["auc"].alias("accuracy"), F.col("metrics")["mape"].alias("mape"))
    return drift.metric_gates(flat, "accuracy", "mape").select("run_id", "accuracy_ok", "mape_ok", "passed")


@query("m16_kpi_gates", f"""WITH {PRED_SQL}, k AS (SELECT value, CASE WHEN event_type = 'purchase' THEN 'prediction_p99_ms' ELSE 'ingest_p99_ms' END AS kpi FROM events),
r AS (SELECT kpi, value, row_number() OVER (PARTITION BY kpi ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY kpi) AS n FROM k), o(kpi, value) AS (
  SELECT kpi, max(value) FROM r WHERE i = floor(n * 0.99) GROUP BY 1
  UNION ALL SELECT 'accuracy', avg(CAST(label = prediction AS DOUBLE)) FROM p
  UNION ALL SELECT 'feature_freshness_seconds', CAST(datesub('second', max(ts) FILTER (event_type = 'purchase'), max(ts)) AS DOUBLE) FROM events
  UNION ALL SELECT 'error_rate', count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) FROM events
  UNION ALL SELECT 'throughput', count(*) / CAST(datesub('second', min(ts), max(ts)) AS DOUBLE) FROM events),
t(kpi, op, threshold) AS (VALUES ('ingest_p99_ms', '<', 500.0::DOUBLE), ('prediction_p99_ms', '<', 200.0::DOUBLE), ('error_rate', '<', 0.01::DOUBLE), ('throughput', '>', 100.0::DOUBLE), ('accuracy', '>=', 0.85::DOUBLE),
  ('feature_freshness_seconds', '<', 3600.0::DOUBLE))
SELECT kpi, op, threshold, value, coalesce(CASE op WHEN '<' THEN value < threshold WHEN '>' THEN value > threshold ELSE value >= threshold END, false) AS passed FROM t LEFT JOIN o USING (kpi)""")
def m16_kpi_gates(spark, sf):
    """Purchases stand for predictions, other events for ingest; features are as fresh as the newest purchase."""
    e = events(spark, sf)
    bought = F.col("event_type") == "purchase"
    timed = e.select("value", F.when(bought, "prediction_p99_ms").otherwise("ingest_p99_ms").alias("kpi"))
    p99 = index_percentiles(timed, "value", {"p99": 0.99}, ["kpi"])
    accuracy = predictions(spark, sf).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("value"))
    rates = e.agg(
        F.timestamp_diff("SECOND", F.max(F.when(bought, F.col("ts"))), F.max("ts")).cast("double").alias("feature_freshness_seconds"),
        F.try_divide(F.count(F.when(F.col("event_type") == "error", 1)), F.count("*")).alias("error_rate"),
        (F.count("*") / F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))).alias("throughput"))
    observed = p99.select("kpi", F.col("p99").alias("value")).unionByName(accuracy.select(F.lit("accuracy").alias("kpi"), "value"))
    for kpi in ("error_rate", "throughput", "feature_freshness_seconds"):
        observed = observed.unionByName(rates.select(F.lit(kpi).alias("kpi"), F.col(kpi).alias("value")))
    return drift.kpi_gates(observed)
