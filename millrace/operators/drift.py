"""Distribution drift (population stability index), its levels, and the retraining decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from .ordered import quantiles

# Drift levels, retraining limits and validation gates.
DRIFT_WARNING, DRIFT_ALERT, DRIFT_CRITICAL, FEATURE_DRIFT = 0.08, 0.1, 0.2, 0.15
MAX_RETRAINS_PER_DAY, COOLDOWN_HOURS = 2, 24
MIN_ACCURACY, MAX_MAPE = 0.85, 15.0
KPI_THRESHOLDS = (
    ("ingest_p99_ms", "<", 500.0), ("prediction_p99_ms", "<", 200.0), ("error_rate", "<", 0.01), ("throughput", ">", 100.0),
    ("accuracy", ">=", 0.85), ("feature_freshness_seconds", "<", 3600.0),
)
BINS, EPSILON = 10, 1e-4


def psi(reference: DataFrame, current: DataFrame, value: str, keys: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Index over the reference's own quantile bins, per key. Shares are floored at ``EPSILON``."""
    keys = list(keys)
    cuts = quantiles(reference, value, {f"c{i}": i / bins for i in range(1, bins)}, keys)
    edges = cuts.select(*keys, F.array(*[f"c{i}" for i in range(1, bins)]).alias("_edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        binned = df.filter(F.col(value).isNotNull())
        binned = binned.join(edges, keys) if keys else binned.withColumn("_edges", edges.scalar())
        slot = F.size(F.filter("_edges", lambda e: e < F.col(value)))
        counted = binned.groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.partitionBy(*keys))  # at most ``bins`` rows per key
        return counted.select(*keys, "bin", (F.col("n") / total).alias(name))

    both = shares(reference, "q").join(shares(current, "p"), [*keys, "bin"], "full_outer")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(EPSILON)) for c in ("p", "q"))
    return both.groupBy(*keys).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def drift_level(score: Column) -> Column:
    return (F.when(score > DRIFT_CRITICAL, "critical").when(score > DRIFT_ALERT, "drift").when(score > DRIFT_WARNING, "warning").otherwise("ok"))


def retrain_decision(scores: DataFrame, score: str, threshold: float = DRIFT_ALERT) -> DataFrame:
    """Action, reason and confidence per score row."""
    above = F.col(score) > threshold
    return scores.withColumns({
        "action": F.when(above, "retrain").otherwise("skip"),
        "reason": F.format_string(f"Drift %.4f %s {threshold}", round_half_up(F.col(score), 4), F.when(above, ">").otherwise("<=")),
        "confidence": F.lit(1.0),
    })


def apply_limits(decisions: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """``in_cooldown``, ``granted_today`` and ``allowed`` of every decision.

    ``decisions`` holds one row per key and evaluation time. A request is in the cooldown if its key had one outside a cooldown less than
    ``COOLDOWN_HOURS`` before. The others take the places of their day, by time and key, over all keys; the first
    ``MAX_RETRAINS_PER_DAY`` are allowed, the rest wait for their next evaluation after the cooldown. Rows without a key or time are not allowed.
    """
    keys = list(keys)
    wants = F.coalesce(F.col("action") == "retrain", F.lit(False))
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    # A key has as many elements as evaluation times.
    requests = decisions.filter(wants).groupBy(*keys).agg(F.sort_array(F.collect_list(seconds)).alias("_asked"))
    ready = lambda done, t: (F.size(done) == 0) | (t >= F.element_at(done, -1) + COOLDOWN_HOURS * 3600)
    step = lambda done, t: F.when(ready(done, t), F.concat(done, F.array(t))).otherwise(done)
    kept = requests.select(*keys, F.explode(F.aggregate("_asked", F.array().cast("array<bigint>"), step)).alias("_seconds"), F.lit(True).alias("_open"))
    marked = decisions.withColumn("_seconds", seconds).join(kept, [*keys, "_seconds"], "left").withColumn("_open", wants & F.col("_open").isNotNull())
    day = Window.partitionBy(F.to_date(ts)).orderBy(ts, *keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_open").cast("int")).over(day), F.lit(0))
    return marked.withColumns({"granted_today": before, "in_cooldown": wants & ~F.col("_open")}).withColumn(
        "allowed", F.col("_open") & (F.col("granted_today") < MAX_RETRAINS_PER_DAY)).drop("_seconds", "_open")


def metric_gates(df: DataFrame, accuracy: str, mape: str) -> DataFrame:
    """Accuracy and MAPE gates; a missing metric does not pass."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    checks = {"accuracy_ok": ok(F.col(accuracy) >= MIN_ACCURACY), "mape_ok": ok(F.col(mape) <= MAX_MAPE)}
    return df.withColumns(checks).withColumn("passed", F.col("accuracy_ok") & F.col("mape_ok"))


def kpi_gates(observed: DataFrame, thresholds=KPI_THRESHOLDS) -> DataFrame:
    """Observed KPIs (``kpi, value``) against their thresholds; a KPI without observation fails."""
    rules = observed.sparkSession.createDataFrame(list(thresholds), "kpi string, op string, threshold double")
    value, threshold = F.col("value"), F.col("threshold")
    passed = F.when(F.col("op") == "<", value < threshold).when(F.col("op") == ">", value > threshold).otherwise(value >= threshold)
    return rules.join(observed, "kpi", "left").select("kpi", "op", "threshold", "value", F.coalesce(passed, F.lit(False)).alias("passed"))
