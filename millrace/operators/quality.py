"""Data-quality report: one conditional aggregate, then one row per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def quality_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Row count, NULL count per required column, price and quantity range."""
    checks = [("row_count_check", "Verify row count > 0", "> 0", F.count("*"), lambda n: n > 0)]
    zero = lambda n: n == 0
    for c in required:
        checks.append((f"null_check_{c}", f"Verify {c} has no nulls", "0", _count(F.col(c).isNull()), zero))
    checks.append(("price_range_check", "Verify all prices are non-negative", "0", _count(F.col("price") < 0), zero))
    checks.append(("quantity_check", "Verify all quantities are >= 1", "0", _count(F.col("quantity") < 1), zero))
    counted = df.agg(*[agg.alias(f"c{i}") for i, (_, _, _, agg, _) in enumerate(checks)])
    rows = [
        F.struct(F.lit(name).alias("name"), F.lit(text).alias("description"), F.lit(expected).alias("expected"),
                 F.col(f"c{i}").alias("actual"), passed(F.col(f"c{i}")).alias("passed"))
        for i, (name, text, expected, _, passed) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*rows)))


def require_passed(report: DataFrame) -> None:
    """Stop the job when a check failed."""
    failed = [r["name"] for r in report.filter(~F.col("passed")).select("name").collect()]
    if failed:
        raise ValueError("data quality checks failed: " + ", ".join(failed))
