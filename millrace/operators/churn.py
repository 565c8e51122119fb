"""User behaviour features, value cohorts and churn labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import stored
from .ordered import quantiles

# Quantiles of the synthetic rule, the share of returning users below which it applies, cohort names.
LOW_REVENUE_Q, MID_REVENUE_Q, RECENCY_Q = 0.35, 0.5, 0.65
MIN_OVERLAP = 0.05
COHORTS = ("Low Value", "Medium Value", "High Value")


def _behaviour(ref_date: Column, only: Column | None = None, with_region: bool = False) -> dict[str, Column]:
    """Aggregates of one user's rows, or of those rows for which ``only`` holds."""
    of = lambda c: F.col(c) if only is None else F.when(only, F.col(c))
    first, last = F.min(of("event_timestamp")), F.max(of("event_timestamp"))
    days_since_first = F.timestamp_diff("DAY", first, ref_date)
    aggregates = {
        "transaction_count": F.count(of("event_id")),
        "total_revenue": S.stable_sum(of("total_amount")), "avg_revenue": S.stable_avg(of("total_amount")),
        "std_revenue": F.coalesce(F.stddev_samp(of("total_amount")), F.lit(0.0)),
        "avg_price": S.stable_avg(of("price")), "max_price": F.max(of("price")), "min_price": F.min(of("price")),
        "total_quantity": F.sum(of("quantity")), "avg_quantity": F.avg(of("quantity")),
        "days_since_first": days_since_first, "days_since_last": F.timestamp_diff("DAY", last, ref_date),
        "primary_channel": F.mode(of("channel"), True),
        "avg_days_between": days_since_first / F.greatest(F.count(of("event_id")), F.lit(1)),
    }
    if with_region:
        aggregates["primary_region"] = F.mode(S.region_of(of("location")), True)
    return aggregates


def user_behavior(tx: DataFrame, ref_date: Column, with_region: bool = False) -> DataFrame:
    """Counts, revenue, price and quantity moments, recency and the modal channel per user, in one aggregation."""
    aggregates = _behaviour(ref_date, with_region=with_region)
    return tx.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(*[c.alias(n) for n, c in aggregates.items()])


def activity_after_cutoff(df: DataFrame, user: str, ts: str, window_days: int) -> DataFrame:
    """Users seen before the cutoff; ``churned`` when none of their rows is later. One aggregation, no join."""
    cutoff = df.agg(F.max(ts) - F.expr(f"INTERVAL '{window_days}' DAY")).scalar()
    seen = df.filter(F.col(user).isNotNull()).groupBy(user).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    return seen.filter(F.col("_first") < cutoff).select(user, (F.col("_last") < cutoff).alias("churned"))


def overlap(df: DataFrame, user: str, ts: str, window_days: int) -> DataFrame:
    """Train users, users active later, users in both, and the shared fraction of train users."""
    cutoff = df.agg(F.max(ts) - F.expr(f"INTERVAL '{window_days}' DAY")).scalar()
    seen = df.filter(F.col(user).isNotNull()).groupBy(user).agg(F.min(ts).alias("f"), F.max(ts).alias("l"))
    early, late = F.col("f") < cutoff, F.col("l") >= cutoff
    count = lambda c: F.count(F.when(c, 1))
    return seen.agg(count(early).alias("train_users"), count(late).alias("active_users"), count(early & late).alias("both")).withColumn(
        "overlap_fraction", F.try_divide("both", "train_users"))


def churn_labels(tx: DataFrame, window_days: int = 7) -> DataFrame:
    """Behaviour features with ``churned``.

    True mode labels users without activity after the cutoff and learns from the time before it. When fewer than 5 % of
    the train users return, the rule on revenue and recency quantiles is used instead.
    """
    # The transactions may be a join of many tables: what is needed of it is written once and read three times.
    tx = stored(tx.select("user_id", "event_id", "event_timestamp", "total_amount", "price", "quantity", "channel"), "churn")
    newest = tx.agg(F.max("event_timestamp")).scalar()
    trained, both = overlap(tx, "user_id", "event_timestamp", window_days).select("train_users", "both").first()
    if not trained or both < MIN_OVERLAP * trained:
        return synthetic_labels(stored(user_behavior(tx, newest), "behaviour"))
    cutoff = newest - F.expr(f"INTERVAL '{window_days}' DAY")
    early = _behaviour(cutoff, F.col("event_timestamp") < cutoff)
    users = tx.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        *[c.alias(n) for n, c in early.items()],
        (F.min("event_timestamp") < cutoff).alias("_trained"), (F.max("event_timestamp") >= cutoff).alias("_returned"))
    return users.filter("_trained").select("user_id", *early, (~F.col("_returned")).cast("int").alias("churned"))


def synthetic_labels(behaviour: DataFrame) -> DataFrame:
    """Labels by the quantile rule. Each threshold reads the per-user table again, so it should be a stored one."""
    revenue = quantiles(behaviour, "total_revenue", {"low": LOW_REVENUE_Q, "mid": MID_REVENUE_Q})
    recency = quantiles(behaviour, "days_since_last", {"late": RECENCY_Q})
    cuts = revenue.select(F.struct("low", "mid")).scalar()
    low = F.col("total_revenue") < cuts["low"]
    medium_and_late = (F.col("total_revenue") < cuts["mid"]) & (F.col("days_since_last") > recency.scalar())
    return behaviour.withColumn("churned", (low | medium_and_late).cast("int"))


def value_cohorts(df: DataFrame, value: str, names=COHORTS) -> DataFrame:
    """Equal-frequency cohorts on interpolated quantiles: ``(a, b]``, lowest value included; ties stay together."""
    n = len(names)
    edges = quantiles(df, value, {f"q{i}": i / n for i in range(1, n)})
    cuts = edges.select(F.struct(*edges.columns)).scalar()
    cohort = F.when(F.col(value).isNull(), F.lit(None).cast("string"))
    for i in range(1, n):
        cohort = cohort.when(F.col(value) <= cuts[f"q{i}"], names[i - 1])
    return df.withColumn("user_cohort", cohort.otherwise(names[-1]))
