"""Row and column access by role, audit records and audit queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import PRIVILEGED_ROLES, mask_value

# Roles that see every row, columns that hold personal data, and the query count that is unusual.
ROW_BYPASS_ROLES = ("admin", "compliance")
PII_COLUMNS = ("email", "ssn", "phone", "address")
UNUSUAL_QUERIES_PER_HOUR = 100


def visible_rows(df: DataFrame, role: str, owner: str, me) -> DataFrame:
    return df if role in ROW_BYPASS_ROLES else df.filter(F.col(owner) == me)


def role_view(df: DataFrame, role: str, masks: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Columns a role may read, with its masks applied; privileged roles see all values."""
    if role in PRIVILEGED_ROLES:
        return df
    return df.select(*[
        mask_value(F.col(c), masks[c], role).alias(c) if c in masks else F.col(c) for c in (columns or df.columns)])


def pii_access(audit: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    recent = F.col("timestamp") > as_of - F.expr(f"INTERVAL '{hours}' HOUR")
    return audit.filter(recent & F.arrays_overlap("accessed_columns", F.array(*[F.lit(c) for c in PII_COLUMNS])))


def unusual_access(audit: DataFrame, as_of: Column, hours: int = 1, limit: int = UNUSUAL_QUERIES_PER_HOUR) -> DataFrame:
    recent = audit.filter(F.col("timestamp") > as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
    return recent.groupBy("user_name").agg(
        F.count("*").alias("query_count"), F.countDistinct("accessed_tables").alias("tables_accessed")
    ).filter(F.col("query_count") > limit)


def write_audited(df: DataFrame, path: str, audit_path: str, actor: str, dataset: str, operation: str = "write") -> None:
    """Write a table and append one audit record. The row count comes from the footers of the files just written."""
    df.write.mode("overwrite").parquet(path)
    record = [(actor, dataset, operation, df.sparkSession.read.parquet(path).count(), list(df.columns))]
    df.sparkSession.createDataFrame(
        record, "actor string, dataset string, operation string, row_count long, columns array<string>"
    ).write.mode("append").parquet(audit_path)
