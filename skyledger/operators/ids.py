"""Surrogate keys: dense sequential ids without a global single-task window, key watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_POS_BITS = 33  # monotonically_increasing_id = (partition index << 33) + position in partition


def max_id(df: DataFrame, id_col: str) -> int:
    """Largest id in use (0 for an empty table); one scalar returned to the driver."""
    value = df.agg(F.max(id_col)).first()[0]
    return int(value or 0)


def key_watermarks(tables: dict[str, DataFrame], id_cols: dict[str, str]) -> DataFrame:
    """Per table: max id with COALESCE(..., 1), as a key-allocation report (one row per table)."""
    parts = [tables[name].agg(F.coalesce(F.max(col), F.lit(1)).cast("bigint").alias("max_id"))
             .select(F.lit(name).alias("table_name"), "max_id")
             for name, col in id_cols.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assign_sequential_ids(df: DataFrame, order_cols: list[str], id_col: str, start: int = 0, keep_order: bool = True) -> DataFrame:
    """Number rows start+1, start+2, ... in ``order_cols`` order (which must be unique), without those columns
    if they aren't kept.

    The rows are range-partitioned and sorted, their per-partition row counts prefix-summed (one
    row per partition), and each row gets offset + position.  The sorted rows are stored with partition
    and position in the shared scratch folder first (compressed columns), so both passes — and any task
    retried after an executor loss — see the same places.  The number of partitions is left to the
    session and to adaptive execution.
    """
    kept = [c for c in df.columns if keep_order or c not in order_cols]
    ranged = stored(df.repartitionByRange(*order_cols)
                    .sortWithinPartitions(*order_cols)
                    .select(*kept, F.monotonically_increasing_id().alias("_mid")), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_mid", _POS_BITS)) \
                   .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (F.lit(start) + F.col("_offset") + F.col("_pos") + 1).cast("bigint"))
            .drop("_mid", "_part", "_pos", "_offset"))


def first_rows(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order (which must be unique; nulls first), in no set order; all rows,
    if there are fewer.

    Only the order columns are stored, range-partitioned (whose sampling reads them once more) and sorted; per-partition counts are prefix-summed, which tells
    the one partition that holds row ``n`` and its place there.  That row's key (one row, broadcast) cuts ``df`` in
    a second pass without a shuffle: however large ``n`` is, no task and no driver holds ``n`` rows.
    """
    if n <= 0:
        return df.limit(0)
    keys = stored(stored(df.select(F.struct(*order_cols).alias("_key")), "unordered").repartitionByRange("_key").sortWithinPartitions("_key")
                  .withColumn("_mid", F.monotonically_increasing_id())
                  .select("_key", F.shiftright("_mid", _POS_BITS).alias("_part"), F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1).alias("_pos")), "keys")
    counts = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition, and of those the one whose rows include row n
    cut_in = counts.select("_part", "_n", before.alias("_before")).where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
    cut = (keys.join(F.broadcast(cut_in), "_part").where(F.col("_pos") == n - 1 - F.col("_before"))
           .agg(F.max("_key").alias("_cut")))                                # one row, null if there are fewer than n
    return df.join(F.broadcast(cut), F.col("_cut").isNull() | (F.struct(*order_cols) <= F.col("_cut"))).drop("_cut")
