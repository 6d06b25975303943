"""Size-checked broadcast: broadcast a side only if the optimizer's size bound for it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side up to this many bytes is broadcast (a fraction of any executor's memory).
BROADCAST_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's output in bytes, from file sizes: an upper bound for
    scans, projections and filters, and far above the truth for joins.  Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its size bound is at most ``max_bytes``, else ``df`` unchanged: a
    shuffle join, which adaptive execution may still turn into a broadcast from measured sizes."""
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df
