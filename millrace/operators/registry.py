"""Training runs, model versions and promotion decisions as table operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from .ordered import top_per_group

# Improvement in percent that promotes a candidate.
MAPE_IMPROVEMENT_PCT = 5.0
MSE_IMPROVEMENT_PCT = 10.0


def keep_metrics(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.withColumn("metrics", F.map_filter("metrics", lambda k, _v: k.isin(*keys)))


def new_runs(runs: DataFrame, experiment: str, since: Column | None = None, status: str = "FINISHED") -> DataFrame:
    """Runs to evaluate, newest first."""
    out = runs.filter((F.col("experiment") == experiment) & (F.col("status") == status))
    if since is not None:
        out = out.filter(F.col("start_time") > since)
    return out.orderBy(F.desc("start_time"), "run_id")


def latest_runs(runs: DataFrame) -> DataFrame:
    return top_per_group(runs, ["experiment"], [F.desc("start_time"), F.asc("run_id")], 1)


def latest_versions(versions: DataFrame, stages: Sequence[str] | None = None) -> DataFrame:
    """Highest version per model and stage."""
    wanted = versions.filter(F.col("stage").isin(*stages)) if stages else versions
    return top_per_group(wanted, ["model_name", "stage"], [F.desc("version")], 1)


def version_details(versions: DataFrame, runs: DataFrame) -> DataFrame:
    return versions.join(runs.select("run_id", "metrics", "params"), "run_id", "left")


def production_baseline(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per model and metric of the run behind the newest production version."""
    current = latest_versions(versions, ["Production"]).select("model_name", "run_id")
    return current.join(runs.select("run_id", "metrics"), "run_id").select(
        "model_name", F.explode("metrics").alias("key", "baseline"))


def compare_to_baseline(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Improvement per metric, long form. No usable baseline value gives a NULL improvement."""
    long = candidates.select("run_id", "model_name", F.explode("metrics").alias("key", "candidate"))
    joined = long.join(baseline, ["model_name", "key"], "left")
    usable = F.nanvl(F.col("baseline"), F.lit(None).cast("double"))
    improvement = F.when(usable > 0, (usable - F.col("candidate")) / usable * 100)
    name = F.lower("key")
    kind = F.when(name.contains("mape"), "mape").when(name.contains("mse") & ~name.contains("rmse"), "mse")
    return joined.withColumns({"improvement": F.nanvl(improvement, F.lit(None).cast("double")), "kind": kind})


def promotion_decisions(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """``promote`` and the reason text per run: MAPE reasons first, then MSE; a model without baseline is promoted."""
    compared = compare_to_baseline(candidates, baseline)
    threshold = F.when(F.col("kind") == "mape", MAPE_IMPROVEMENT_PCT).when(F.col("kind") == "mse", MSE_IMPROVEMENT_PCT)
    better = F.coalesce(F.col("improvement") >= threshold, F.lit(False))
    verb = F.when(F.col("kind") == "mape", "improved").otherwise("reduced")
    text = F.format_string("%s %s by %.2f%% (threshold: %.1f%%)", "key", verb, round_half_up(F.col("improvement")), threshold)
    per_run = compared.groupBy("run_id", "model_name").agg(
        F.bool_or(better).alias("_better"),
        F.count("baseline").alias("_known"),
        F.array_sort(F.collect_list(F.when(better, F.struct("kind", "key", text.alias("t"))))).alias("_reasons"),
    )
    no_baseline = F.col("_known") == 0
    reasons = F.array_join(F.transform("_reasons", lambda r: r["t"]), "; ")
    return per_run.select(
        "run_id", "model_name", (no_baseline | F.col("_better")).alias("promote"),
        F.when(no_baseline, "No production baseline - first model").when(F.col("_better"), reasons)
        .otherwise("No significant improvement").alias("reason"))


def best_by(df: DataFrame, keys: Sequence[str], name: str, metric: str, largest: bool = False) -> DataFrame:
    """Best row per group by one metric, names break ties."""
    order = F.desc_nulls_last(metric) if largest else F.asc_nulls_last(metric)
    return top_per_group(df, keys, [order, F.asc(name)], 1)


def rollback_targets(versions: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The version each model in production goes back to, or why it does not.

    ``requested`` (``model_name, requested``; one row a model) names versions; without one it is the previous version. Refused are a model
    without a production version, the first version without a request, a version that does not exist, and the one already in production.
    """
    current = latest_versions(versions, ["Production"]).select("model_name", F.col("version").alias("current_version"))
    known = versions.join(current, "model_name", "left")
    if requested is not None:
        known = known.join(requested.select("model_name", "requested"), "model_name", "left")
    else:
        known = known.withColumn("requested", F.lit(None).cast("long"))
    found = known.groupBy("model_name").agg(
        F.max("current_version").alias("current_version"), F.max("requested").alias("_asked"),
        F.max(F.when(F.col("version") < F.col("current_version"), F.col("version"))).alias("_older"),
        F.coalesce(F.bool_or(F.col("version") == F.col("requested")), F.lit(False)).alias("_known"))
    asked = F.col("_asked")
    reason = (F.when(F.col("current_version").isNull(), "no production version")
              .when(asked.isNull() & F.col("_older").isNull(), "no previous version")
              .when(asked == F.col("current_version"), "already in production")
              .when(asked.isNotNull() & ~F.col("_known"), "unknown version").otherwise("rollback"))
    target = F.when(F.col("reason") == "rollback", F.coalesce(asked.cast(versions.schema["version"].dataType), "_older"))
    return found.withColumn("reason", reason).select("model_name", "current_version", target.alias("target_version"), "reason")


def transition(versions: DataFrame, moves: DataFrame, archive_current: bool = True) -> DataFrame:
    """Apply stage moves (``model_name, version, to_stage``; one target stage per model): others there are archived."""
    per_model = moves.groupBy("model_name").agg(F.max("to_stage").alias("_stage"))
    marked = versions.join(moves, ["model_name", "version"], "left").join(per_model, "model_name", "left")
    stage = F.when(F.col("to_stage").isNotNull(), F.col("to_stage"))
    if archive_current:
        stage = stage.when(F.col("stage") == F.col("_stage"), "Archived")
    return marked.withColumn("stage", stage.otherwise(F.col("stage"))).drop("to_stage", "_stage")
