"""Alert rules over metric samples on an evaluation grid: hold times, inhibition, routing, grouping.

A metric frame has ``metric, series, job, ts, value`` with one row per series and grid step, so windows per series hold as
many rows as there are steps, whatever the volume of raw data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Alert, metric, comparison, threshold, hold in seconds, severity, team.
RULES = (
    ("HighPredictionLatency", "prediction_p99_seconds", ">", 0.5, 300, "warning", "ml-platform"),
    ("CriticalPredictionLatency", "prediction_p99_seconds", ">", 2.0, 120, "critical", "ml-platform"),
    ("HighPredictionErrorRate", "prediction_error_ratio", ">", 0.05, 300, "critical", "ml-platform"),
    ("ModelDriftDetected", "model_drift_score", ">", 0.1, 600, "warning", "ml-platform"),
    ("CriticalModelDrift", "model_drift_score", ">", 0.2, 300, "critical", "ml-platform"),
    ("FeatureDrift", "feature_drift_score", ">", 0.15, 900, "warning", "ml-platform"),
    ("PredictionDistributionShift", "prediction_shift", ">", 2.0, 1800, "warning", "ml-platform"),
    ("KafkaConsumerLag", "consumer_lag", ">", 10000.0, 300, "warning", "data-platform"),
    ("CriticalKafkaConsumerLag", "consumer_lag", ">", 100000.0, 300, "critical", "data-platform"),
    ("KafkaConsumerStalled", "consumer_stalled", ">", 0.0, 600, "critical", "data-platform"),
    ("KafkaUnderReplicatedPartitions", "under_replicated_partitions", ">", 0.0, 300, "warning", "data-platform"),
    ("ServiceDown", "up", "==", 0.0, 120, "critical", "ml-platform"),
    ("HighMemoryUsage", "memory_ratio", ">", 0.9, 300, "warning", "ml-platform"),
    ("PodRestartingFrequently", "restarts_1h", ">", 3.0, 0, "warning", "ml-platform"),
    ("StaleTrainingData", "training_data_age_seconds", ">", 86400.0, 3600, "warning", "ml-platform"),
    ("FeatureStoreLag", "feature_lag_seconds", ">", 3600.0, 900, "warning", "ml-platform"),
    ("AgentActionFailures", "agent_failure_ratio", ">", 0.1, 300, "warning", "ml-platform"),
    ("SlowAgentExecution", "agent_p95_seconds", ">", 60.0, 600, "warning", "ml-platform"),
)
RULE_SCHEMA = "alertname string, metric string, op string, threshold double, hold long, severity string, team string"

# Routes in order (severity, team, name pattern, receiver, continue); the first that does not continue ends.
ROUTES = (
    (0, "critical", None, None, "critical-alerts", True),
    (1, "critical", "ml-platform", None, "pagerduty-ml", False),
    (2, None, "ml-platform", None, "slack-ml-platform", False),
    (3, None, "data-platform", None, "slack-data-platform", False),
    (4, None, None, ".*Drift.*", "slack-model-monitoring", False),
)
DEFAULT_RECEIVER = "slack-ml-platform"
REPEAT_SECONDS = 4 * 3600


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def evaluations(metrics: DataFrame, rules=RULES, step_seconds: int = 3600) -> DataFrame:
    """Grid points where a rule holds, since when, and whether it has held long enough to fire.

    A run of true points is broken by a false point or by a missing step.
    """
    # The rule table is a constant of a few rows.
    joined = metrics.join(F.broadcast(rule_table(metrics.sparkSession, rules)), "metric")
    hit = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    by_time = Window.partitionBy("alertname", "series").orderBy("ts")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(by_time), F.col("ts"))
    breaks = F.when(F.col("hit") & (gap <= step_seconds), 0).otherwise(1)
    runs = joined.withColumn("hit", hit).withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(by_time))
    within = Window.partitionBy("alertname", "series", "_run")
    held = F.timestamp_diff("SECOND", F.col("active_at"), F.col("ts"))
    return (
        runs.filter("hit").withColumn("active_at", F.min("ts").over(within))
        .withColumn("state", F.when(held >= F.col("hold"), "firing").otherwise("pending"))
        .drop("hit", "_break", "_run", "op")
    )


def alert_instances(evaluated: DataFrame) -> DataFrame:
    """One row per uninterrupted run: start, last time, last value and final state."""
    firing = F.bool_or(F.col("state") == "firing")
    return evaluated.groupBy("alertname", "series", "job", "severity", "team", "active_at").agg(
        F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("value"),
        F.when(firing, "firing").otherwise("pending").alias("state"))


def by_state(alerts: DataFrame, state: str) -> DataFrame:
    return alerts.filter(F.col("state") == state)


def inhibit(alerts: DataFrame) -> DataFrame:
    """Drop warnings next to a critical of the same name and job, and everything of a job whose service is down.

    Both conditions are flags over the alerts of one job at one time, so the frame is read and shuffled once.
    """
    same_job = Window.partitionBy("ts", "job")
    same_alert = Window.partitionBy("ts", "job", "alertname")
    is_down = F.col("alertname") == "ServiceDown"
    flagged = alerts.withColumns({
        "_down": F.bool_or(is_down).over(same_job), "_critical": F.bool_or(F.col("severity") == "critical").over(same_alert)})
    kept = ~((F.col("severity") == "warning") & F.col("_critical")) & (is_down | ~F.col("_down"))
    return flagged.filter(kept).drop("_down", "_critical")


def _matches(severity, team, pattern) -> Column:
    rule = F.lit(True)
    if severity:
        rule = rule & (F.col("severity") == severity)
    if team:
        rule = rule & (F.col("team") == team)
    if pattern:
        rule = rule & F.col("alertname").rlike(f"^(?:{pattern})$")
    return rule


def route(alerts: DataFrame, routes=ROUTES) -> DataFrame:
    """One row per alert and receiver. Routes are a constant list, so they become expressions and not a join."""
    final = F.when(F.lit(False), F.lit(None).cast("string"))
    continued = []
    for _ord, severity, team, pattern, receiver, goes_on in routes:
        rule = _matches(severity, team, pattern)
        if goes_on:
            continued.append(F.when(rule, F.lit(receiver)))
        else:
            final = final.when(rule, receiver)
    receivers = F.array_compact(F.array(*continued, final.otherwise(DEFAULT_RECEIVER)))
    return alerts.withColumn("receiver", F.explode(F.array_distinct(receivers)))


def notifications(alerts: DataFrame, repeat_seconds: int = REPEAT_SECONDS, step_seconds: int = 3600) -> DataFrame:
    """Groups by name, job and severity, repeated at most every four hours within a run.

    A step without an alert of the group ends the run; an alert after it is sent at once.
    """
    groups = alerts.groupBy("alertname", "job", "severity", "ts").agg(F.count("*").alias("alerts"))
    by_time = Window.partitionBy("alertname", "job", "severity").orderBy("ts")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(by_time), F.col("ts"))
    runs = groups.withColumn("_new", F.when(gap <= step_seconds, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_time))
    first = F.min("ts").over(Window.partitionBy("alertname", "job", "severity", "_run"))
    slot = F.floor(F.timestamp_diff("SECOND", first, F.col("ts")) / repeat_seconds)
    return runs.withColumn("slot", slot).groupBy("alertname", "job", "severity", "_run", "slot").agg(
        F.min("ts").alias("sent_at"), F.max("alerts").alias("alerts")).drop("_run")


def report_message(sections: Column) -> Column:
    """``title, value`` structs as message text."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("**"), s["title"], F.lit(":** "), s["value"])), "\n")
