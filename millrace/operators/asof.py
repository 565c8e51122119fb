"""Point-in-time join: for each request row the newest feature row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import hot_cuts, with_time_slice


def asof_join(
    requests: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    request_ts: str,
    feature_ts: str,
    payload: Sequence[str],
    created: str | None = None,
    ttl_seconds: int | None = None,
    slice_seconds: int = 3600,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left as-of join by union and ``last(ignore nulls)``, cut into (entity, time slice) partitions.

    The last feature row of each slice is carried forward over a table with one row per slice, so one entity that holds
    a large share of all rows is spread over its slices instead of landing in one task. A slice with more than ``hot_rows``
    rows of both sides is cut further, at quantiles of its rows, so a burst is spread as well. Ties on time go to the newest
    ``created``. Matches older than the TTL become NULL.
    """
    keys = list(keys)
    created_col = F.col(created) if created else F.lit(None).cast("timestamp_ntz")
    packed = F.struct(F.col(feature_ts).alias("_ts"), *[F.col(c) for c in payload])

    left = requests.select(
        *keys, F.col(request_ts).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast("timestamp_ntz").alias("_created"),
        F.struct(*[c for c in requests.columns if c not in keys]).alias("_request"),
    )
    right = features.dropna(subset=[*keys, feature_ts]).select(
        *keys, F.col(feature_ts).alias("_t"), F.lit(0).alias("_side"),
        created_col.alias("_created"), packed.alias("_match"),
    )
    cuts = hot_cuts(left.select(*keys, "_t").unionByName(right.select(*keys, "_t")), keys, "_t", slice_seconds, hot_rows)
    left, right = (with_time_slice(side, cuts, keys, "_t", slice_seconds) for side in (left, right))

    newest = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_t"), F.desc_nulls_last("_created"))
    slice_last = right.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").select(*keys, "_slice", "_match")
    request_slices = left.groupBy(*keys, "_slice").agg(F.lit(1).alias("_wanted"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        request_slices.join(slice_last, [*keys, "_slice"], "full_outer")
        .withColumn("_match", F.last("_match", ignorenulls=True).over(before))
        .filter(F.col("_wanted").isNotNull() & F.col("_match").isNotNull())
        .select(*keys, F.lit(None).cast("timestamp_ntz").alias("_t"), "_slice", F.lit(0).alias("_side"),
                F.lit(None).cast("timestamp_ntz").alias("_created"), "_match")
    )
    upto = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(F.asc_nulls_first("_t"), "_side", F.asc_nulls_first("_created"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = (
        left.unionByName(right, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
        .withColumn("_match", F.last("_match", ignorenulls=True).over(upto))
        .filter("_side = 1")
    )
    match = F.col("_match")
    if ttl_seconds is not None:
        age = F.timestamp_diff("MICROSECOND", F.col("_match._ts"), F.col("_t"))
        match = F.when(age <= ttl_seconds * 1_000_000, match)
    return merged.withColumn("_match", match).select(
        *keys,
        *[F.col(f"_request.{c}").alias(c) for c in requests.columns if c not in keys],
        F.col("_match._ts").alias("matched_ts"),
        *[F.col(f"_match.{c}").alias(c) for c in payload],
    )
