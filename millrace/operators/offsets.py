"""Consumer lag and topic statistics from offset tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import step_of


def visible_topics(df: DataFrame, include_internal: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    if not include_internal:
        df = df.filter(~F.col("topic").startswith("_"))
    return df.filter(F.col("topic").isin(*only)) if only else df


def partition_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Lag per group, topic and partition. Nothing committed counts from zero; lag is never negative."""
    current = F.coalesce("committed", F.lit(0))
    return committed.join(ends, ["topic", "partition"]).select(
        "group_id", "topic", "partition", current.alias("current_offset"), "end_offset",
        F.greatest(F.lit(0), F.col("end_offset") - current).alias("lag"))


def group_lag(lag: DataFrame) -> DataFrame:
    """Per topic and, with a NULL topic, per group."""
    return lag.groupingSets([["group_id", "topic"], ["group_id"]], "group_id", "topic").agg(
        F.sum("lag").alias("total_lag"), F.count("*").alias("partition_count"))


def topic_stats(ends: DataFrame) -> DataFrame:
    return ends.groupBy("topic").agg(
        F.sum(F.col("end_offset") - F.col("begin_offset")).alias("messages"), F.count("*").alias("partitions"))


def under_replicated(heard: DataFrame, topic: Sequence[str], partition: str, replica: str, partitions: int, replicas: int, step_seconds: int = 3600) -> DataFrame:
    """(topic, step, thin): partitions of a topic of which fewer than ``replicas`` replicas were heard in a step, those without any included.

    ``heard`` holds a row with ``ts`` per sign of life of a replica. A step in which nothing of a topic is heard has no row.
    """
    per_partition = heard.groupBy(*topic, step_of("ts", step_seconds).alias("step"), partition).agg(F.count_distinct(replica).alias("_heard"))
    whole = F.count(F.when(F.col("_heard") >= replicas, 1))
    return per_partition.groupBy(*topic, "step").agg((F.lit(partitions) - whole).alias("thin"))
