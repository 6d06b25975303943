"""Keep-first / keep-last per key by ordinal, as partial aggregations (no row_number window)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key_cols: list[str], order_cols: list[str], pick, keep_order: bool) -> DataFrame:
    value_cols = [c for c in df.columns if c not in key_cols and (keep_order or c not in order_cols)]
    order = F.struct(*order_cols)
    agg = df.groupBy(*key_cols).agg(pick(F.struct(*value_cols), order).alias("_row"))
    return agg.select(*key_cols, *[F.col("_row")[c].alias(c) for c in value_cols])


def keep_first(df: DataFrame, key_cols: list[str], order_cols: list[str], keep_order: bool = True) -> DataFrame:
    """One row per key: the one earliest in ``order_cols`` (= INSERT ... ON CONFLICT DO NOTHING
    applied in file order).  ``min_by`` combines map-side, so a hot key never gathers in one task."""
    return _pick(df, key_cols, order_cols, F.min_by, keep_order)


def keep_last(df: DataFrame, key_cols: list[str], order_cols: list[str], keep_order: bool = True) -> DataFrame:
    """One row per key: the latest in ``order_cols`` (= sequential upserts in file order)."""
    return _pick(df, key_cols, order_cols, F.max_by, keep_order)
