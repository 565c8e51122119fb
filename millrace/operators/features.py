"""User and product feature tables over a lookback window, and serving lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import stored
from .ordered import modal_value, quantiles

NEVER_PURCHASED_DAYS = 999


def latest(df: DataFrame, ts: str) -> Column:
    """The newest time as a scalar subquery: it runs once and reaches the scan as a literal."""
    return df.agg(F.max(ts)).scalar()


def lookback(df: DataFrame, as_of: Column, days: int, ts: str = "event_timestamp", fallback: bool = False) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``. With ``fallback`` an empty window means the whole table."""
    inside = F.col(ts) >= as_of - F.expr(f"INTERVAL '{days}' DAY")
    if fallback:
        inside = inside | (df.agg(F.count(F.when(inside, 1))).scalar() == 0)
    return df.filter(inside)


def user_features(tx: DataFrame, as_of: Column, lookback_days: int = 30, fallback: bool = False) -> DataFrame:
    """One row per user in one aggregation; partial aggregates by (user, product) absorb hot users before the shuffle."""
    window = lookback(tx, as_of, lookback_days, fallback=fallback).filter(F.col("user_id").isNotNull())
    since = F.timestamp_diff("DAY", F.max("event_timestamp"), as_of)
    return window.groupBy("user_id").agg(
        S.round_half_up(S.stable_sum(F.col("total_amount"))).alias("user_total_spend_30d"),
        S.round_half_up(S.stable_avg(F.col("total_amount"))).alias("user_avg_order_value"),
        S.round_half_up(F.avg("quantity")).alias("user_avg_quantity"),
        F.sum("quantity").alias("user_total_quantity_30d"),
        F.count("event_id").alias("user_transaction_count_30d"),
        F.countDistinct("product_id").alias("user_unique_products_30d"),
        F.coalesce(since, F.lit(NEVER_PURCHASED_DAYS)).alias("user_days_since_last_purchase"),
        F.coalesce(F.mode("channel", True), F.lit("unknown")).alias("user_favorite_channel"),
    ).withColumns({"event_timestamp": as_of, "created_timestamp": as_of})


def product_features(tx: DataFrame, as_of: Column, lookback_days: int = 30, fallback: bool = False) -> DataFrame:
    """One row per product; the exact median comes from the sliced order statistics, not from one task per product."""
    window = lookback(tx, as_of, lookback_days, fallback=fallback).filter(F.col("product_id").isNotNull())
    # Three aggregates read the window; it is joined and filtered once.
    window = stored(window.select("product_id", "price", "quantity", "total_amount", "user_id", S.region_of(F.col("location")).alias("_region")), "product-window")
    base = window.groupBy("product_id").agg(
        S.round_half_up(S.stable_avg(F.col("price"))).alias("product_avg_price_30d"),
        S.round_half_up(F.min("price")).alias("product_min_price_30d"),
        S.round_half_up(F.max("price")).alias("product_max_price_30d"),
        F.sum("quantity").alias("product_total_sales_30d"),
        S.round_half_up(S.stable_sum(F.col("total_amount"))).alias("product_total_revenue_30d"),
        F.countDistinct("user_id").alias("product_unique_buyers_30d"),
        S.round_half_up(F.avg("quantity")).alias("product_avg_quantity_per_order"),
        F.count("product_id").alias("product_transaction_count_30d"),
    )
    median = quantiles(window, "price", {"_median": 0.5}, ["product_id"])
    region = modal_value(window, ["product_id"], "_region").select("product_id", F.col("_region").alias("product_top_region"))
    return (
        base.join(median, "product_id", "left").join(region, "product_id", "left")
        .withColumn("product_median_price_30d", S.round_half_up(F.col("_median")))
        .withColumns({"event_timestamp": as_of, "created_timestamp": as_of})
        .withColumn("product_top_region", F.coalesce("product_top_region", F.lit("Unknown")))
        .drop("_median")
    )


def online_lookup(requests: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Latest features per requested entity; an unknown entity gets NULLs."""
    return requests.join(snapshot, key, "left")
