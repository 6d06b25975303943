"""Fact maintenance: upsert on the five-column natural key, and append-only live inserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FACT_FLIGHTPERFORMANCE, FACT_KEY, FACT_UPDATE_COLUMNS, conform
from ..session import stored
from .broadcast import broadcast_if_small
from .ids import assign_sequential_ids, max_id

# Columns an upsert keeps from the first insert of a key.
FACT_FIRST_COLUMNS = ["airline_id", "aircraft_id", "flight_month"]
_LIVE_COLUMNS = [f.name for f in FACT_FLIGHTPERFORMANCE.fields
                 if f.name not in FACT_KEY + FACT_UPDATE_COLUMNS + FACT_FIRST_COLUMNS
                 + ["flight_performance_id", "created_at", "updated_at"]]


def collapse_source(resolved: DataFrame, order_cols: list[str]) -> DataFrame:
    """One row per fact key: first-insert columns from the earliest row, updatable columns
    from the latest, as sequential INSERT ... ON CONFLICT DO UPDATE would leave them, with the
    number of source rows.

    The source is stored, and its keys alone are counted.  Rows whose key comes once stay where they are; of the
    others the least and the greatest (place in file order, columns) aggregate map-side, so a key holding a third
    of the batch is fine (places are unique, so the columns never decide).  If the keys that come again are too
    many to broadcast, rows move by key once."""
    first = [c for c in FACT_FIRST_COLUMNS + _LIVE_COLUMNS if c in resolved.columns]
    rows = stored(resolved.select(*FACT_KEY, F.struct(*order_cols).alias("_at"), F.struct(*first).alias("_first"),
                                  F.struct(*FACT_UPDATE_COLUMNS).alias("_last")), "resolved")
    again = stored(rows.groupBy(*FACT_KEY).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(*FACT_KEY), "again")
    again = broadcast_if_small(again)
    once = rows.join(again, FACT_KEY, "left_anti").select(*FACT_KEY, F.col("_at").alias("_first_at"), "_first", "_last", F.lit(1).cast("bigint").alias("_rows"))
    folded = rows.join(again, FACT_KEY, "left_semi").groupBy(*FACT_KEY).agg(
        F.min(F.struct("_at", "_first")).alias("_min"), F.max(F.struct("_at", "_last")).alias("_max"), F.count(F.lit(1)).alias("_rows"))
    return once.unionByName(folded.select(*FACT_KEY, F.col("_min._at").alias("_first_at"), "_min._first", "_max._last", "_rows"))


def _touched_months(source: DataFrame) -> list[int]:
    # distinct yyyymm of a batch: bounded by the calendar span of the batch
    return sorted(r[0] for r in source.select("_first.flight_month").distinct().collect() if r[0] is not None)


@dataclass
class FactMerge:
    """What an upsert changes.  All but ``before`` are projections of the stored ``merged``."""
    affected: DataFrame               # new rows of every touched file, and inserted rows
    statuses: DataFrame               # per fact key: inserted or updated, and how many source rows it had
    merged: DataFrame                 # the merge itself, with ``_status`` (unchanged rows of touched files too)
    before: DataFrame                 # the target's rows that ``affected`` replaces
    files: list[str] | None           # files that hold them; None if the target has no files: then whole months


def reads_files(df: DataFrame) -> bool:
    """Whether the rows of ``df`` still know the file they come from (a scan, with projections and filters)."""
    try:
        df.select("_metadata.file_path")
        return True
    except AnalysisException:
        return False


def matched_files(target: DataFrame, source: DataFrame) -> DataFrame:
    """``source`` (one row a fact key) with ``_file``, the target's file that holds the key; null for a new key.
    The target is read for its key columns only."""
    held = target.select(*FACT_KEY, F.col("_metadata.file_path").alias("_file"))
    return source.join(held, FACT_KEY, "left")


def upsert_fact(target: DataFrame, resolved: DataFrame, order_cols: list[str], run_ts: Column,
                prune_partitions: bool = True, target_is_empty: bool = False) -> FactMerge:
    """Merge resolved source rows into the fact.

    Only what the batch touches is merged and rewritten.  Months (``flight_month``) outside the batch are never
    read.  In its months the key columns are joined to the batch's keys, which gives the files that hold a
    matched key; those files alone are read whole, merged and replaced.  New keys go to new files.

    The source is reduced to one row per key first; only inserted keys are numbered, after the
    target's max id in the file order of their first row.  Updated keys keep id, airline, aircraft
    and created_at and take the batch's last values of the five update columns plus
    ``updated_at = run_ts``.
    """
    src = collapse_source(resolved, order_cols)
    if target_is_empty:     # every key is new: the source's rows are numbered as they are
        return _first_merge(target, assign_sequential_ids(src, ["_first_at"], "flight_performance_id", keep_order=False), run_ts)
    src = stored(src, "source")
    start = max_id(target, "flight_performance_id")
    files = None
    if prune_partitions:
        months = _touched_months(src)
        target = target.where(F.col("flight_month").isin(months)) if months else target.limit(0)
    if reads_files(target):
        located = stored(matched_files(target, src), "located")
        new, known = (located.where(f"_file is {x}null").drop("_file") for x in ("", "not "))
        # names of touched files: at most those of the batch's months
        files = sorted(r[0] for r in located.where("_file is not null").select("_file").distinct().collect())
        target = target.where(F.col("_metadata.file_path").isin(files)) if files else target.limit(0)
    else:
        keys = target.select(*FACT_KEY)
        new, known = src.join(keys, FACT_KEY, "left_anti"), src.join(keys, FACT_KEY, "left_semi")
    numbered = assign_sequential_ids(new, ["_first_at"], "_new_id", start=start, keep_order=False)

    # new keys have no row in the target: they follow the joined rows, and don't move again
    joined = target.alias("t").join(known.drop("_first_at").alias("s"), on=FACT_KEY, how="left")
    j = joined.unionByName(numbered.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields if f.name not in FACT_KEY]),
                           allowMissingColumns=True)
    has_t = F.col("flight_performance_id").isNotNull()
    has_s = F.col("_rows").isNotNull()

    cols = {}
    cols["flight_performance_id"] = F.when(has_t, F.col("flight_performance_id")) \
        .otherwise(F.col("_new_id"))
    for c in FACT_KEY:
        cols[c] = F.col(c)
    for c in FACT_FIRST_COLUMNS:
        cols[c] = F.when(has_t, F.col(c)).otherwise(F.col(f"_first.{c}"))
    for c in FACT_UPDATE_COLUMNS:
        cols[c] = F.when(has_s, F.col(f"_last.{c}")).otherwise(F.col(c))
    cols["created_at"] = F.when(has_t, F.col("created_at")).otherwise(run_ts)
    cols["updated_at"] = F.when(has_s, run_ts).otherwise(F.col("updated_at"))
    src_live = set(src.schema["_first"].dataType.names)
    for c in _LIVE_COLUMNS:
        from_src = F.col(f"_first.{c}") if c in src_live else F.lit(None)
        cols[c] = F.when(has_t, F.col(c)).otherwise(from_src)
    status = F.when(has_t & has_s, F.lit("updated")).when(has_s, F.lit("inserted")).otherwise(F.lit("unchanged"))
    merged = stored(j.select(*[v.alias(k) for k, v in cols.items()], status.alias("_status"),
                             F.coalesce("_rows", F.lit(0)).alias("_rows")), "merge")
    affected = conform(merged, FACT_FLIGHTPERFORMANCE)
    statuses = merged.where(F.col("_status") != "unchanged").select(*FACT_KEY, "_status", "_rows")
    return FactMerge(affected, statuses, merged, target, files)


def _first_merge(target: DataFrame, numbered: DataFrame, run_ts: Column) -> FactMerge:
    """The merge of a numbered source into an empty target: a projection of the stored, numbered rows."""
    first = set(numbered.schema["_first"].dataType.names)
    cols = {"flight_performance_id": F.col("flight_performance_id")} | {c: F.col(c) for c in FACT_KEY}
    cols |= {c: F.col(f"_first.{c}") for c in FACT_FIRST_COLUMNS} | {c: F.col(f"_last.{c}") for c in FACT_UPDATE_COLUMNS}
    cols |= {"created_at": run_ts, "updated_at": run_ts}
    cols |= {c: F.col(f"_first.{c}") if c in first else F.lit(None) for c in _LIVE_COLUMNS}
    merged = numbered.select(*[v.alias(k) for k, v in cols.items()], F.lit("inserted").alias("_status"), "_rows")
    return FactMerge(conform(merged, FACT_FLIGHTPERFORMANCE), merged.select(*FACT_KEY, "_status", "_rows"), merged, target, None)


def untouched_rows(fact: DataFrame, merge: FactMerge) -> DataFrame:
    """The rows of the whole fact that a merge leaves as they are."""
    if merge.files is not None:
        return fact.where(~F.col("_metadata.file_path").isin(merge.files)) if merge.files else fact
    months = [r[0] for r in merge.affected.select("flight_month").distinct().collect()]
    return fact.where(~F.col("flight_month").isin(months)) if months else fact


def run_counters(statuses: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """inserted / updated / skipped counts of one run, as a 3-row DataFrame.  Every source row
    counts once: a new key's first row is an insert, each further row of a key an update."""
    spark = statuses.sparkSession
    names = spark.createDataFrame([("inserted",), ("updated",), ("skipped",)], "status string")
    n = F.col("_rows") if "_rows" in statuses.columns else F.lit(1)
    new = F.col("_status") == "inserted"
    counts = statuses.agg(F.sum(F.when(new, 1).otherwise(0)).alias("inserted"), F.sum(F.when(new, n - 1).otherwise(n)).alias("updated"))
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("status"), F.col(c).cast("bigint").alias("rows")) for c in ("inserted", "updated")])).alias("r")).select("r.*")
    if rejected is not None:
        counts = counts.unionByName(rejected.agg(F.count(F.lit(1)).alias("rows"))
                                    .select(F.lit("skipped").alias("status"), "rows"))
    return names.join(F.broadcast(counts), "status", "left").select(      # three rows
        "status", F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"))


def append_fact(target: DataFrame, rows: DataFrame, order_cols: list[str]) -> DataFrame:
    """Append-only insert (no key check): ids continue after the target's max id in file order."""
    start = max_id(target, "flight_performance_id")
    numbered = assign_sequential_ids(rows, order_cols, "flight_performance_id", start=start, keep_order=False)
    return conform(numbered, FACT_FLIGHTPERFORMANCE)
