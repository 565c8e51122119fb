"""Profiling tables: KPI row, breakdowns, histograms, description, correlation, missing values, live KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import stored
from .ordered import quantiles


def daily_series(df: DataFrame, ts: str, amount: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``ds, y, transaction_count`` per day (and series)."""
    return df.groupBy(*keys, F.to_date(ts).alias("ds")).agg(S.stable_sum(amount).alias("y"), F.count("*").alias("transaction_count"))


def kpi_row(tx: DataFrame, approximate: bool = False) -> DataFrame:
    """Exact by default; ``approximate`` replaces the distinct counts by sketches, which need no extra shuffle."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    # The joins behind the rows run once; the median and each distinct count read just their column.
    tx = stored(tx.select("total_amount", "user_id", "product_id", "location", "quantity", "event_timestamp"), "kpi-rows")
    median = quantiles(tx, "total_amount", {"m": 0.5}).scalar()
    count = lambda c: tx.agg(distinct(c)).scalar()
    base = tx.agg(
        F.count("*").alias("total_transactions"), S.stable_sum(F.col("total_amount")).alias("total_revenue"),
        S.stable_avg(F.col("total_amount")).alias("avg_revenue"), F.max("total_amount").alias("max_revenue"),
        F.avg("quantity").alias("avg_items"),
        F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event"))
    return base.withColumns({
        "unique_users": count("user_id"), "unique_products": count("product_id"), "unique_locations": count("location"),
        "median_revenue": median}).withColumn("span_days", F.timestamp_diff("DAY", F.col("first_event"), F.col("last_event")))


def breakdown(tx: DataFrame, by: str) -> DataFrame:
    """Count, revenue and share of all rows per value, largest revenue first."""
    grouped = tx.groupBy(by).agg(
        F.count("*").alias("transactions"), S.stable_sum(F.col("total_amount")).alias("revenue"),
        S.stable_avg(F.col("total_amount")).alias("avg_revenue"))
    # The same aggregate again: its exchange is reused.
    share = F.col("transactions") / grouped.agg(F.sum("transactions")).scalar() * 100
    return grouped.withColumn("share_pct", share).orderBy(F.desc("revenue"), by)


def daily_trends(tx: DataFrame, ts: str = "event_timestamp") -> DataFrame:
    return tx.groupBy(F.to_date(ts).alias("date")).agg(
        F.count("*").alias("transactions"), S.stable_sum(F.col("total_amount")).alias("revenue"), F.countDistinct("user_id").alias("users"))


def value_counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins; the maximum falls into the last bin."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    width = (high - low) / bins
    position = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col(value) - low, width)), F.lit(bins - 1)))
    return df.filter(F.col(value).isNotNull()).groupBy(position.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, value: str) -> DataFrame:
    quartiles = quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    q = quartiles.select(F.struct("p25", "p50", "p75")).scalar()
    moments = df.agg(F.count(value).alias("count"), S.stable_avg(F.col(value)).alias("mean"), F.stddev_samp(value).alias("std"),
                     F.min(value).alias("min"), F.max(value).alias("max"))
    return moments.select("*", q["p25"].alias("p25"), q["p50"].alias("p50"), q["p75"].alias("p75"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one pass, long form, both triangles and the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows += [(x, y, f"c{i}") for x, y in ({(a, b), (b, a)})]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(c).alias("r")) for x, y, c in sorted(rows)])))


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[(F.count(F.when(F.col(c).isNull(), 1)) / F.count("*") * 100).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_pct")) for c in columns]))).orderBy(F.desc("missing_pct"), "column")


def with_share(df: DataFrame, by: str) -> DataFrame:
    """Count and share of the total per value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())


def live_kpis(events: DataFrame, as_of: Column, newest: int = 100) -> DataFrame:
    """Counts of the last minute, five minutes and hour, rates, and facts of the newest rows, long form."""
    since = lambda m: F.count(F.when(F.col("ts") > as_of - F.expr(f"INTERVAL '{m}' MINUTE"), 1))
    counts = events.agg(F.count("*").alias("total_events"), since(1).alias("events_1m"), since(5).alias("events_5m"), since(60).alias("events_1h"))
    names = ("total_events", "events_1m", "events_5m", "events_1h")
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    pairs.append(F.struct(F.lit("events_per_sec").alias("metric"), (F.col("events_1m") / 60).alias("value")))
    recent = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)
    average = recent.agg(F.lit("avg_price").alias("metric"), S.stable_avg(F.nullif(F.col("value"), F.lit(0.0))).alias("value"))
    types = recent.groupBy(F.concat(F.lit("type_"), "event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.inline(F.array(*pairs))).unionByName(average).unionByName(types)


def run_statistics(raw: DataFrame, valid: Column, day: Column, seconds: Column) -> DataFrame:
    """Input, output and invalid counts, the number of day partitions and input records per second, in one pass.

    ``seconds`` is the duration of the run, a literal or an aggregate; the rate is NULL where it is 0 or missing.
    """
    ok = F.coalesce(valid, F.lit(False))
    return raw.agg(
        F.try_divide(F.count("*"), seconds).alias("records_per_second"),
        F.count("*").alias("input_count"), F.count(F.when(ok, 1)).alias("output_count"), F.count(F.when(~ok, 1)).alias("invalid_count"),
        F.countDistinct(F.when(ok, day)).alias("partitions"))
