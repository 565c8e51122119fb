"""Name -> (Spark query, equivalent SQL)."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import pin_utc

AREAS = (
    "scans", "projections", "filters", "joins", "aggregates", "evaluation", "windows", "ordering",
    "retrieval", "streams", "models", "monitoring", "governance",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under the inventory name."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_utc(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, run, oracle)
        return run

    return register


def load_all() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"millrace.plans.{area}")
    return QUERIES
