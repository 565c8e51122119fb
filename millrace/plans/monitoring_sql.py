"""SQL of the metric frame, the rules and the alert instances, shared by several oracles."""

from ..operators.alerts import RULES
from ..operators.metrics import AGENT_BUCKETS, DURATION_BUCKETS

_VALUES = ",\n  ".join(
    f"('{a}', '{m}', '{op}', CAST({t} AS DOUBLE), {h}, '{s}', '{team}')" for a, m, op, t, h, s, team in RULES)


def counts_sql(value: str, edges) -> str:
    """A list of the values up to each edge, and of all values."""
    return "[" + ", ".join(f"count(*) FILTER ({value} <= {e}::DOUBLE)" for e in edges) + f", count({value})]"


def quantile_sql(counts: str, q: float, edges) -> str:
    """The quantile in a list of cumulative counts, linear inside a bucket."""
    rank = f"({q}::DOUBLE * {counts}[{len(edges) + 1}])"
    at = "(1 + " + " + ".join(f"CAST({counts}[{i}] < {rank} AS INTEGER)" for i in range(1, len(edges) + 1)) + ")"
    upper = "[" + ", ".join(f"{e}::DOUBLE" for e in edges) + "]"
    below, before = f"coalesce({upper}[{at} - 1], 0)", f"coalesce({counts}[{at} - 1], 0)"
    return f"""CASE WHEN {at} > {len(edges)} THEN {edges[-1]}::DOUBLE
      ELSE {below} + ({upper}[{at}] - {below}) * coalesce(({rank} - {before}) / nullif({counts}[{at}] - {before}, 0), 0) END"""


METRICS_SQL = f"""hourly AS (
  SELECT date_trunc('hour', ts) AS ts, event_type AS series, count(*) AS n, max(value) AS mx, count(*) FILTER (value > 40) AS err,
    count(*) FILTER (value < 15) AS failed, CAST(printf('%.11e', sum(value)) AS DOUBLE) / count(value) AS mean,
    {counts_sql('(value / 50)', DURATION_BUCKETS)} AS latency, {counts_sql('value', AGENT_BUCKETS)} AS agent,
    max(ts) FILTER (value > 99) AS trained, max(ts) FILTER (event_id % 4 = 0) AS synced FROM events GROUP BY 1, 2),
aged AS (SELECT *, CAST(datesub('second', max(trained) OVER upto, ts + INTERVAL 1 HOUR) AS DOUBLE) AS trained_age,
    CAST(datesub('second', max(synced) OVER upto, ts + INTERVAL 1 HOUR) AS DOUBLE) AS synced_age
  FROM hourly WINDOW upto AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)),
around AS (SELECT date_trunc('hour', ts) AS ts, event_type AS series, count(value) AS n, sum(value) AS s, sum(value * value) AS ss FROM events GROUP BY 1, 2),
earlier AS (SELECT *, sum(n) OVER w AS bn, sum(s) OVER w AS bs, sum(ss) OVER w AS bss FROM around
  WINDOW w AS (PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)),
heard AS (SELECT event_type AS series, user_id % 2 AS part, date_trunc('hour', ts) AS ts, count(DISTINCT event_id % 2) AS r, max(event_id + 1) AS e,
    max(CASE WHEN ts < TIMESTAMP '2024-01-20' THEN event_id + 1 END) AS c FROM events GROUP BY 1, 2, 3),
steps AS (SELECT series, part, unnest(generate_series((SELECT min(ts) FROM heard), (SELECT max(ts) FROM heard), INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT series, part FROM heard)),
followed AS (SELECT steps.series, steps.ts, max(c) OVER w AS done, max(e) OVER w AS known,
    max(c) OVER (PARTITION BY steps.series, steps.part ORDER BY steps.ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
  FROM steps LEFT JOIN heard USING (series, part, ts) WINDOW w AS (PARTITION BY steps.series, steps.part ORDER BY steps.ts ROWS UNBOUNDED PRECEDING)),
named AS (
  SELECT unnest(['prediction_p99_seconds', 'prediction_error_ratio', 'model_drift_score', 'feature_drift_score', 'consumer_lag', 'up',
      'memory_ratio', 'restarts_1h', 'training_data_age_seconds', 'feature_lag_seconds', 'agent_failure_ratio', 'agent_p95_seconds']) AS metric,
    unnest([{quantile_sql('latency', 0.99, DURATION_BUCKETS)}, CAST(err AS DOUBLE) / n, abs(mean - 50) / 100, abs(mean - 50) / 100,
      CAST(n * 3000 AS DOUBLE), CASE WHEN n < 2 THEN 0.0 ELSE 1.0 END, mx / 100, CAST(n AS DOUBLE), trained_age, synced_age, CAST(failed AS DOUBLE) / n,
      {quantile_sql('agent', 0.95, AGENT_BUCKETS)}]) AS value, series, ts FROM aged
  UNION ALL SELECT 'prediction_shift', round(abs(s / n - bs / bn) / nullif(sqrt(greatest(bss / bn - (bs / bn) * (bs / bn), 0)), 0), 6), series, ts FROM earlier
  UNION ALL SELECT 'under_replicated_partitions', CAST(2 - count(*) FILTER (r >= 2) AS DOUBLE), series, ts FROM heard GROUP BY 3, 4
  UNION ALL SELECT 'consumer_stalled', CAST(count(*) AS DOUBLE), series, ts FROM followed WHERE done = previous AND known > done GROUP BY 3, 4),
metrics AS (SELECT *, CASE WHEN series IN ('purchase', 'view') THEN 'predict-service' WHEN series = 'click' THEN 'rag-service' ELSE 'mlflow' END AS job
  FROM named WHERE value IS NOT NULL)"""

ALERTS_SQL = METRICS_SQL + f""",
rules(alertname, metric, op, threshold, hold, severity, team) AS (VALUES
  {_VALUES}),
joined AS (SELECT *, CASE op WHEN '>' THEN value > threshold ELSE value = threshold END AS hit FROM metrics JOIN rules USING (metric)),
marked AS (
  SELECT *, CASE WHEN hit AND ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM joined
  WINDOW w AS (PARTITION BY alertname, series ORDER BY ts)),
islands AS (SELECT *, sum(brk) OVER (PARTITION BY alertname, series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM marked),
evals AS (SELECT alertname, series, job, severity, team, ts, value, threshold, hold, metric,
    min(ts) OVER (PARTITION BY alertname, series, isl) AS active_at FROM islands WHERE hit),
states AS (SELECT *, CASE WHEN epoch(ts) - epoch(active_at) >= hold THEN 'firing' ELSE 'pending' END AS state FROM evals),
alerts AS (SELECT alertname, series, job, severity, team, active_at, max(ts) AS last_ts, arg_max(value, ts) AS value,
    CASE WHEN bool_or(state = 'firing') THEN 'firing' ELSE 'pending' END AS state FROM states GROUP BY ALL)"""
