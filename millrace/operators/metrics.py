"""Metric series: latest values, step grids, counter increases, histogram quantiles, shift and freshness.

Raw samples are first reduced to one row per series and grid step; windows run over those rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .asof import asof_join
from .ordered import previous_row, top_per_group

# Request duration buckets in seconds.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
#: Edges for the run time of agents in seconds.
AGENT_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
SHIFT_THRESHOLD = 2.0


def error_ratio(df: DataFrame, is_error: Column, keys: Sequence[str] = ()) -> DataFrame:
    errors, good = F.count(F.when(is_error, 1)), F.count(F.when(~is_error, 1))
    return df.groupBy(*keys).agg(F.try_divide(errors, F.count("*")).alias("error_ratio"), F.try_divide(good, F.count("*")).alias("success_rate"))


def step_of(ts: str, seconds: int) -> Column:
    """Start of the grid step that holds ``ts``."""
    seconds_of = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(seconds_of / seconds) * seconds).cast("timestamp_ntz")


def instant(samples: DataFrame, at: Column, staleness_seconds: int = 300, series: str = "series", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Newest sample per series at a time, unless it is stale."""
    fresh = (F.col(ts) <= at) & (F.col(ts) > at - F.expr(f"INTERVAL '{staleness_seconds}' SECOND"))
    return top_per_group(samples.filter(fresh), [series], [F.desc(ts), F.desc(tie)], 1)


def range_grid(samples: DataFrame, start: Column, end: Column, step_seconds: int, value: str, staleness_seconds: int = 300,
               series: str = "series", ts: str = "ts") -> DataFrame:
    """Value per series at every step of a grid: an as-of join with the staleness as its limit."""
    steps = F.explode(F.sequence(start, end, F.expr(f"INTERVAL '{step_seconds}' SECOND"))).alias("step")
    grid = samples.select(series).distinct().select(series, steps)
    return asof_join(grid, samples.select(series, F.col(ts).alias("_sample_ts"), value), [series], "step", "_sample_ts", [value],
                     ttl_seconds=staleness_seconds, slice_seconds=max(3600, step_seconds)).drop("matched_ts")


def _names(series: str | Sequence[str]) -> list[str]:
    return [series] if isinstance(series, str) else list(series)


def counter_deltas(samples: DataFrame, counter: str = "counter", series: str | Sequence[str] = "series", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Increase against the previous sample; after a reset the new value itself. The first sample adds nothing."""
    paired = previous_row(samples, _names(series), [ts, tie], [counter], ts)
    value, before = F.col(counter), F.col(f"prev_{counter}")
    return paired.withColumn("delta", F.when(before.isNull(), 0).when(value < before, value).otherwise(value - before)).drop(f"prev_{counter}")


def increase(samples: DataFrame, range_seconds: int, step_seconds: int = 300, counter: str = "counter", series: str | Sequence[str] = "series",
             ts: str = "ts") -> DataFrame:
    """``increase`` and per-second ``rate`` over a range ending with each step that has samples; no extrapolation to the edges."""
    names = _names(series)
    per_step = counter_deltas(samples, counter, names, ts).groupBy(*names, step_of(ts, step_seconds).alias("step")).agg(F.sum("delta").alias("delta"))
    seconds = F.unix_seconds(F.col("step").cast("timestamp"))
    window = Window.partitionBy(*names).orderBy(seconds).rangeBetween(-(range_seconds - step_seconds), 0)
    total = F.sum("delta").over(window)
    return per_step.select(*names, "step", total.alias("increase"), (total / range_seconds).alias("rate"))


def distribution_shift(samples: DataFrame, value: str = "gauge", series: str = "series", ts: str = "ts") -> DataFrame:
    """|mean of the hour - mean of the 24 hours before| in population standard deviations, per series and hour."""
    hour = 3600
    v = F.col(value)
    per_hour = samples.groupBy(series, step_of(ts, hour).alias("step")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))
    # Moments are taken from the series' least hourly mean, so large values with small spread keep their digits.
    centred = F.col("mean") - F.min("mean").over(Window.partitionBy(series))
    moments = per_hour.withColumn("c", centred).withColumns({
        "s": F.col("n") * F.col("c"), "ss": F.col("n") * (F.col("variance") + F.col("c") * F.col("c"))})
    day_before = Window.partitionBy(series).orderBy(F.unix_seconds(F.col("step").cast("timestamp"))).rangeBetween(-24 * hour, -hour)
    n, s, ss = (F.sum(c).over(day_before) for c in ("n", "s", "ss"))
    before = s / n
    deviation = F.sqrt(F.greatest(ss / n - before * before, F.lit(0.0)))
    shift = F.try_divide(F.abs(F.col("c") - before), deviation)
    per_hour = moments
    return per_hour.withColumn("shift", shift).select(series, "step", "shift", (F.coalesce(F.col("shift"), F.lit(0.0)) > SHIFT_THRESHOLD).alias("shifted"))


def cumulative_counts(value: Column, buckets: Sequence[float] = DURATION_BUCKETS) -> Column:
    """Values up to each bucket's edge, and all values at the end: an aggregate."""
    return F.array(*[F.count(F.when(value <= b, 1)) for b in buckets], F.count(value))


def quantile_of_counts(counts: str, q: float, buckets: Sequence[float] = DURATION_BUCKETS) -> Column:
    """Quantile from a column of ``cumulative_counts``, linear inside a bucket; beyond the last bucket its upper edge."""
    rank = F.lit(float(q)) * F.element_at(counts, -1)
    edges = F.array(*[F.lit(float(b)) for b in buckets])
    at = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int")
    upper, lower = F.get(edges, at - 1), F.coalesce(F.get(edges, at - 2), F.lit(0.0))
    before = F.coalesce(F.get(counts, at - 2), F.lit(0))
    inside = F.get(counts, at - 1) - before
    # With an empty bucket the rank sits on its lower edge.
    estimate = lower + (upper - lower) * F.coalesce(F.try_divide(rank - before, inside), F.lit(0.0))
    return F.when(at > len(buckets), F.lit(float(buckets[-1]))).otherwise(estimate)


def histogram_quantile(df: DataFrame, value: str, q: float, keys: Sequence[str] = (), buckets: Sequence[float] = DURATION_BUCKETS) -> DataFrame:
    """Quantile from cumulative buckets. All cumulative counts come from one aggregation."""
    keys = list(keys)
    counted = df.groupBy(*keys).agg(cumulative_counts(F.col(value), buckets).alias("_cum"))
    return counted.select(*keys, quantile_of_counts("_cum", q, buckets).alias("quantile"))


def age_at_step(newest: str, step_seconds: int, series: str = "series", step: str = "ts") -> Column:
    """Seconds from the newest update of a series to the end of a step; ``newest`` is the time of a step's last update. Null before the first."""
    upto = Window.partitionBy(series).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col(step) + F.expr(f"INTERVAL '{step_seconds}' SECOND")
    return F.timestamp_diff("SECOND", F.max(newest).over(upto), end).cast("double")


def bucket_rates(samples: DataFrame, range_seconds: int, step_seconds: int, keys: Sequence[str], instances: Sequence[str], le: str = "le") -> DataFrame:
    """(keys, step, le, rate): rates of cumulative bucket counters, resets included, summed over instances by upper edge."""
    per_bucket = increase(samples, range_seconds, step_seconds, series=[*keys, *instances, le])
    return per_bucket.groupBy(*keys, "step", le).agg((F.sum("increase") / range_seconds).alias("rate"))


def quantile_of_rates(rates: DataFrame, q: float, keys: Sequence[str], le: str = "le", rate: str = "rate") -> DataFrame:
    """(keys, quantile) from cumulative rates by upper edge, linear inside a bucket.

    Instances need not expose the same buckets, so the sums may fall from one edge to the next: they are made monotone by their running
    maximum. The quantile is null without an infinite bucket, with no other bucket, or with nothing counted; in the infinite bucket it is
    the highest finite edge, in a first bucket with an edge of at most 0 that edge.
    """
    edges, sums = F.transform("_b", lambda b: b[le]), F.transform("_b", lambda b: b["_rate"])
    # A group has as many rows as there are edges.
    grouped = rates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(le).cast("double").alias(le), F.col(rate).cast("double").alias("_rate")))).alias("_b"))
    cumulative = F.transform("_sums", lambda x, i: F.array_max(F.slice("_sums", 1, i + 1)))
    shaped = grouped.select(*keys, edges.alias("_edges"), sums.alias("_sums")).select(*keys, "_edges", cumulative.alias("_cum"))
    size, total = F.size("_edges"), F.element_at("_cum", -1)
    rank = F.lit(float(q)) * total
    found = shaped.withColumn("_at", F.array_position(F.transform("_cum", lambda c: c >= rank), True).cast("int"))
    at = F.col("_at")
    upper, before = F.get("_edges", at - 1), F.coalesce(F.get("_cum", at - 2), F.lit(0.0))
    lower = F.coalesce(F.get("_edges", at - 2), F.lit(0.0))
    share = F.coalesce(F.try_divide(rank - before, F.get("_cum", at - 1) - before), F.lit(0.0))
    known = (F.element_at("_edges", -1) == float("inf")) & (size > 1) & (total > 0)
    value = (F.when(at == size, F.get("_edges", size - 2)).when((at == 1) & (upper <= 0), upper).otherwise(lower + (upper - lower) * share))
    return found.select(*keys, F.when(known, value).alias("quantile"))


def freshness(df: DataFrame, name: str, ts: str, as_of: Column) -> DataFrame:
    return df.agg(F.max(ts).alias("last_update")).select(
        F.lit(name).alias("source"), "last_update", F.timestamp_diff("SECOND", F.col("last_update"), as_of).alias("age_seconds"))


def panel_counts(df: DataFrame, ts: str, by: str, width: str = "5 minutes") -> DataFrame:
    return df.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def rate_panels(samples: DataFrame, is_error: Column, range_seconds: int = 300, step_seconds: int = 300, series: str | Sequence[str] = "series") -> DataFrame:
    """Per step the rate of all counters together and the share of it that errors have (NULL without any increase), resets included."""
    per_series = increase(samples, range_seconds, step_seconds, series=series)
    total = F.sum("increase")
    return per_series.groupBy("step").agg((total / range_seconds).alias("request_rate"),
                                          F.try_divide(F.coalesce(F.sum(F.when(is_error, F.col("increase"))), F.lit(0)), total).alias("error_rate"))


def latest_increase(samples: DataFrame, as_of: Column, range_seconds: int = 86400, series: str | Sequence[str] = "series", ts: str = "ts") -> DataFrame:
    """``sum by (series) (increase(counter[range]))`` at one time; a sample before the range gives the first one its increase."""
    names = _names(series)
    inside = (F.col(ts) > as_of - F.make_dt_interval(secs=F.lit(range_seconds))) & (F.col(ts) <= as_of)
    return counter_deltas(samples, series=names, ts=ts).groupBy(*names).agg(F.coalesce(F.sum(F.when(inside, F.col("delta"))), F.lit(0)).alias("increase"))


def stalled_consumers(commits: DataFrame, keys: Sequence[str], step_seconds: int = 3600) -> DataFrame:
    """Grid steps where a consumer committed nothing new although its lag is positive.

    ``commits``: keys, ``ts``, ``committed`` (NULL when only the log grew) and ``end_offset``.
    """
    keys = list(keys)
    per_step = commits.groupBy(*keys, step_of("ts", step_seconds).alias("step")).agg(F.max("committed").alias("c"), F.max("end_offset").alias("e"))
    first, last = commits.agg(F.min(step_of("ts", step_seconds))).scalar(), commits.agg(F.max(step_of("ts", step_seconds))).scalar()
    grid = commits.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(first, last, F.expr(f"INTERVAL '{step_seconds}' SECOND"))).alias("step"))
    upto = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(per_step, [*keys, "step"], "left").select(
        *keys, "step", F.max("c").over(upto).alias("committed"), F.max("c").over(before).alias("previous"), F.max("e").over(upto).alias("end_offset"))
    lag = F.col("end_offset") - F.coalesce("committed", F.lit(0))
    return filled.withColumn("lag", lag).filter((F.col("committed") == F.col("previous")) & (F.col("lag") > 0)).select(*keys, "step", "lag")
