"""Order statistics that never put a whole group into one task.

A window over a hot key (or over no key at all) sorts the whole group in a single task. Here each group is cut at
approximate quantiles first; the cuts decide only where the data is split, so every result stays exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS_PER_GROUP = 64
HOT_GROUP_WEIGHT = 1_000_000  # groups heavier than this are cut


def _slice_number(value: Column, cuts: Column, width: int) -> Column:
    """Number of cuts below a value, by two short scans: over every ``width``-th cut, then inside one stretch."""
    below = lambda cs: F.size(F.filter(cs, lambda c: c < value))
    coarse = F.filter(cuts, lambda c, i: (i + 1) % width == 0)
    found = F.transform(F.array(below(coarse)), lambda n: n * width + below(F.slice(cuts, n * width + 1, width - 1)))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(0))


def running_totals(
    df: DataFrame, order: str, measures: Sequence[str], keys: Sequence[str] = (), splits: int | None = None,
    hot_weight: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<m>`` by ascending ``order`` and group totals ``total_<m>``.

    ``df`` holds one row per (keys, order) with non-negative measures: aggregate to distinct order values first. Groups
    whose measures sum to more than ``hot_weight`` are cut into ``splits`` slices; without keys everything is one group and
    is always cut, into as many slices as there are shuffle partitions.
    """
    keys = list(keys)
    hot_weight = HOT_GROUP_WEIGHT if hot_weight is None else hot_weight
    if splits is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        splits = SPLITS_PER_GROUP if keys else min(4096, max(16, partitions))
    width = max(2, round(splits ** 0.5))
    # No row is dropped: a negative measure stops the job, a missing one counts as nothing. The check keeps the measures in all
    # branches, so they share one shuffle of ``df``.
    for m in measures:
        df = df.withColumn(m, F.coalesce(m, F.lit(0))).filter(
            F.when(F.col(m) < 0, F.raise_error(F.lit(f"negative measure {m}")).cast("boolean")).otherwise(True))
    cuts = F.percentile_approx(order, [i / splits for i in range(1, splits)], max(2000, 10 * splits)).alias("_cuts")
    if keys:
        weight = sum((F.col(f"_w_{m}") for m in measures), F.lit(0))
        hot = df.groupBy(*keys).agg(*[F.sum(m).alias(f"_w_{m}") for m in measures]).filter(weight > hot_weight).select(*keys)
        hot_cuts = df.join(hot, keys, "left_semi").groupBy(*keys).agg(cuts)
        with_cuts = df.join(hot_cuts, keys, "left")
    else:
        with_cuts = df.withColumn("_cuts", df.agg(cuts).scalar())
    sliced = with_cuts.withColumn("_slice", _slice_number(F.col(order), F.col("_cuts"), width)).drop("_cuts")

    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    # At most ``splits`` rows per group reach these windows.
    offsets = per_slice.select(
        *keys, "_slice",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(group).alias(f"total_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(offsets, [*keys, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_off_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def _ranked(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    weighted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return running_totals(weighted, "_v", ["_n"], keys)


def _value_at(rank: Column) -> Column:
    """The value holding 0-based ``rank``, inside an aggregate over ranked distinct values."""
    return F.max(F.when((F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("cum__n")), F.col("_v")))


def quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``qs``."""
    keys = list(keys)
    aggregates = []
    for name, q in qs.items():
        position = (F.col("total__n") - 1) * F.lit(float(q))
        low, high = _value_at(F.floor(position)), _value_at(F.ceil(position))
        share = F.max(position - F.floor(position))
        aggregates.append((low * (1 - share) + high * share).alias(name))
    ranked = _ranked(df, value, keys)
    return ranked.groupBy(*keys).agg(*aggregates)


def index_percentiles(df: DataFrame, value: str, qs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Percentiles by position: the element at ``floor(n * q)`` of the sorted values."""
    keys = list(keys)
    total = F.col("total__n")
    position = lambda q: F.least(F.floor(total * F.lit(float(q))), total - 1)
    return _ranked(df, value, keys).groupBy(*keys).agg(*[_value_at(position(q)).alias(n) for n, q in qs.items()])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group. Spark keeps only ``k`` rows per group and task before the shuffle (WindowGroupLimit)."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def modal_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, the smallest on a tie."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return top_per_group(counted, keys, [F.desc("n"), F.asc(value)])


def hot_cuts(times: DataFrame, keys: Sequence[str], ts: str, slice_seconds: int, hot_rows: int | None = None) -> DataFrame:
    """(keys, _slice, _cuts): for slices of more than ``hot_rows`` rows, the times at which they are cut further, at quantiles of their rows."""
    hot_rows = HOT_GROUP_WEIGHT if hot_rows is None else hot_rows
    sliced = times.select(*keys, _time_slice(ts, slice_seconds).alias("_slice"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    hot = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*keys, "_slice")
    shares = [i / SPLITS_PER_GROUP for i in range(1, SPLITS_PER_GROUP)]
    return sliced.join(hot, [*keys, "_slice"], "left_semi").groupBy(*keys, "_slice").agg(F.percentile_approx("_at", shares, 10_000).alias("_cuts"))


def _time_slice(ts: str, slice_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds)


def with_time_slice(df: DataFrame, cuts: DataFrame, keys: Sequence[str], ts: str, slice_seconds: int) -> DataFrame:
    """``df`` with ``_slice``, rising with time: the slice of ``slice_seconds`` and the stretch inside it. Rows of one time share a slice."""
    sliced = df.withColumn("_slice", _time_slice(ts, slice_seconds)).join(cuts, [*keys, "_slice"], "left")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    inside = F.when(F.col("_cuts").isNull(), 0).otherwise(_slice_number(at, F.col("_cuts"), max(2, round(SPLITS_PER_GROUP ** 0.5))))
    return sliced.withColumn("_slice", F.col("_slice") * SPLITS_PER_GROUP + inside).select(*df.columns, "_slice")


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], ts: str, slice_seconds: int = 3600,
    hot_rows: int | None = None,
) -> DataFrame:
    """``prev_<c>`` of the preceding row of the series, computed per time slice.

    Only the last row of each slice is carried into the next one, so a hot series is spread over its slices, and a slice with
    too many rows over stretches of it.
    """
    keys, order = list(keys), list(order)
    sliced = with_time_slice(df, hot_cuts(df, keys, ts, slice_seconds, hot_rows), keys, ts, slice_seconds)
    packed = F.struct(*columns)
    tail = top_per_group(sliced, [*keys, "_slice"], [F.desc(c) for c in order]).select(
        *keys, "_slice", packed.alias("_tail"))
    # One row per slice and series here, never the rows themselves.
    carry = tail.select(
        *keys, "_slice", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    joined = sliced.join(carry, [*keys, "_slice"])
    with_previous = joined.withColumn("_prev", F.coalesce(F.lag(packed).over(inside), F.col("_carry")))
    return with_previous.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])
