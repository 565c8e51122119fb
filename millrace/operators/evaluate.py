"""Evaluation of predictions: confusion, class metrics, ROC, segments, fairness, forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals

# The 80 % rule, the largest tolerated rate gap, the smallest segment.
PARITY_RATIO, ODDS_GAP, MIN_SEGMENT = 0.8, 0.10, 5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def forecast_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAPE over non-zero actuals (infinite when there are none) and MSE."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100, F.lit(float("inf"))).alias("mape"),
        F.avg((y - p) * (y - p)).alias("mse"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, label, prediction).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support, precision, recall and F1 per class, from the confusion counts."""
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    counts = confusion(df, label, prediction).select(F.inline(sides)).groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return counts.select("class", "support", "tp", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    per_class = class_metrics(df, label, prediction)
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return per_class.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), mean("precision").alias("precision_weighted"),
                         mean("recall").alias("recall_weighted"), mean("f1").alias("f1_weighted"))


def binary_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    count = lambda c: F.count(F.when(c, 1))
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.avg(label).alias("positive_rate"), count(y & p).alias("tp"), count(~y & p).alias("fp"),
        count(y & ~p).alias("fn"), count(y == p).alias("right"))
    tp = F.col("tp")
    precision, recall = _ratio(tp, tp + F.col("fp")), _ratio(tp, tp + F.col("fn"))
    return grouped.select(*keys, "n_samples", "positive_rate", (F.col("right") / F.col("n_samples")).alias("accuracy"),
                          precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def _score_totals(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Labels are 0 or 1; any other stops the job. Rows without a label or a score are not judged."""
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    y = F.when(F.col(label).isin(0, 1), F.col(label).cast("long")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("long"))
    per_score = known.groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return running_totals(per_score, score, ["pos", "neg"], keys)


def roc_auc(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Rank form with average ranks for ties; NULL where only one class is present."""
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    return _score_totals(df, keys, label, score).groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("total_pos").cast("double")) * F.max("total_neg")).alias("auc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """TPR and FPR when everything at or above the threshold counts as positive."""
    above = lambda m: F.col(f"total_{m}") - F.col(f"cum_{m}") + F.col(m)
    return _score_totals(df, keys, label, score).select(
        *keys, F.col(score).alias("threshold"), F.try_divide(above("pos"), F.col("total_pos")).alias("tpr"),
        F.try_divide(above("neg"), F.col("total_neg")).alias("fpr"))


def segment_metrics(df: DataFrame, segment: str = "segment", label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """Binary metrics and AUC per segment; small segments are left out."""
    metrics = binary_metrics(df, [segment], label, prediction).filter(F.col("n_samples") >= MIN_SEGMENT)
    return metrics.join(roc_auc(df, [segment], label, score), segment, "left")


def demographic_parity(df: DataFrame, group: str = "segment", prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """(selection rate per group, one row with the min/max ratio and its verdict)."""
    rates = df.groupBy(group).agg(F.count("*").alias("n_samples"), F.avg(prediction).alias("selection_rate"))
    low, high = F.min("selection_rate"), F.max("selection_rate")
    ratio = F.when(high > 0, low / high).otherwise(1.0)
    return rates, rates.agg(ratio.alias("parity_ratio")).withColumn("passed", F.col("parity_ratio") >= PARITY_RATIO)


def equalized_odds(df: DataFrame, group: str = "segment", label: str = "label", prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """(TPR and FPR per group, one row with both gaps and their verdict)."""
    hit = (F.col(prediction) == 1).cast("int")
    rates = df.groupBy(group).agg(F.count("*").alias("n_samples"), F.avg(F.when(F.col(label) == 1, hit)).alias("tpr"),
                                  F.avg(F.when(F.col(label) == 0, hit)).alias("fpr"))
    gaps = rates.agg((F.max("tpr") - F.min("tpr")).alias("tpr_gap"), (F.max("fpr") - F.min("fpr")).alias("fpr_gap"))
    return rates, gaps.withColumn("passed", (F.col("tpr_gap") <= ODDS_GAP) & (F.col("fpr_gap") <= ODDS_GAP))


# ---------------------------------------------------------------- feature contributions

def linear_contributions(df: DataFrame, row_id: str, features: Sequence[str], coefficients: Column | dict[str, Column],
                         means: Column | dict[str, Column]) -> DataFrame:
    """Exact contributions of a linear model: ``beta * (x - mean)`` per feature, long form."""
    items = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                      (coefficients[f] * (F.col(f) - means[f])).alias("contribution")) for f in features]
    return df.select(row_id, F.inline(F.array(*items)))


def importance(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "feature")


def top_drivers(contributions: DataFrame, row_id: str, k: int = 3) -> DataFrame:
    """Strongest positive and negative features per row. A row has a fixed, small number of features."""
    items = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("s"), "feature", "contribution")))
    names = lambda keep: F.slice(F.transform(F.filter(items, keep), lambda i: i["feature"]), 1, k)
    return contributions.groupBy(row_id).agg(
        F.array_join(names(lambda i: i["contribution"] > 0), ",").alias("positive_drivers"),
        F.array_join(names(lambda i: i["contribution"] < 0), ",").alias("negative_drivers"))
