"""Order of dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: executions that may run at the same time.
CONCURRENCY = 100


def priority_keys() -> list[Column]:
    """Urgency first (missing = 0.0), then a fixed tie-break."""
    return [
        F.coalesce(F.col("urgency_score"), F.lit(0.0)).desc(),
        F.col("execute_at").asc(),
        F.col("task_id").asc(),
    ]


def priority_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*priority_keys())


def dispatch_batch(df: DataFrame, k: int = CONCURRENCY) -> DataFrame:
    """The ``k`` most urgent rows, as a distributed top-k."""
    return priority_order(df).limit(k)
