"""Live updates as Structured Streaming: landed API page files -> ``foreachBatch`` -> the same
upsert (or append) the batch job runs, committed to the warehouse folder.

Each micro-batch reads the warehouse that the newest manifest names, merges the batch, writes
every table and touched fact month to folders of a new version and then one manifest that also
records the batch id.  A crash before the manifest leaves the old version in force; a replayed
batch is recognised by its id.  Nothing is cached across batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.live_update import upsert_live
from ..plans.warehouse import read_warehouse, write_warehouse
from ..session import ensure_checkpoint_dir
from ..sources.live_json import page_rows


def page_stream(spark: SparkSession, landing_dir: str) -> DataFrame:
    """One row per landed page file: its place in page order and its whole text."""
    return page_rows(spark.readStream.format("text").option("wholetext", True).load(landing_dir))


def commit_batch(spark: SparkSession, pages: DataFrame, warehouse_dir: str, run_ts: str | None = None,
                 batch_id: int | None = None) -> dict:
    """Merge one batch of pages into the warehouse folder; returns the run counters."""
    ensure_checkpoint_dir(spark)
    result = upsert_live(spark, read_warehouse(spark, warehouse_dir), pages, run_ts)
    counters = {r["status"]: r["rows"] for r in result.counters().collect()}   # three rows
    write_warehouse(result, warehouse_dir, batch_id)
    return counters


def run_live_stream(spark: SparkSession, landing_dir: str, warehouse_dir: str, checkpoint_location: str,
                    run_ts: str | None = None, available_now: bool = True):
    """Process every landed page file not yet committed (``Trigger.AvailableNow``) or keep
    polling (``processingTime``).  Returns the finished query and per-batch counters."""
    log: list[tuple[int, dict]] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        log.append((batch_id, commit_batch(batch.sparkSession, batch, warehouse_dir, run_ts, batch_id)))

    writer = page_stream(spark, landing_dir).writeStream.foreachBatch(handle) \
        .option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query, log
