"""Running live aggregates: per airport, counts and sums kept in keyed streaming state (``transformWithState``).

Each micro-batch of landed pages is parsed and accepted as the live update does it, added up for each airport within
every Arrow batch (so a hub airport sends a few rows a task, not one a flight), and then added to the airport's state.
The state lives in Spark's state store and its checkpoint: a restarted query goes on where it ended.  What changed in
a micro-batch is written to a folder named by its id; a replayed batch replaces its own folder, and readers take each
airport's latest row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import clean_code
from ..operators.features import LIVE_AIRPORT_COLUMNS
from ..plans.live_update import accepted_records, tag_records
from ..sources.live_json import normalise, page_records

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the state holds for an airport: flights, late flights and delay minutes by role (fixed order).
TOTALS = ["departures", "late_departures", "departure_minutes", "arrivals", "late_arrivals", "arrival_minutes"]
TOTALS_SCHEMA = ", ".join(f"{c} bigint" for c in TOTALS)
#: Fixed value: a delay beyond so many minutes is late (reference rule).
LATE_MINUTES = 15


def role_rows(pages: DataFrame) -> DataFrame:
    """Each accepted record of the pages in both its roles: (airport_code, departing, minutes)."""
    records = accepted_records(tag_records(normalise(page_records(pages))))
    roles = F.array(
        F.struct(clean_code("origin_airport_code").alias("airport_code"), F.lit(True).alias("departing"),
                 F.col("departure_delay_minutes_live").cast("bigint").alias("minutes")),
        F.struct(clean_code("destination_airport_code").alias("airport_code"), F.lit(False).alias("departing"),
                 F.col("arrival_delay_minutes_live").cast("bigint").alias("minutes")))
    return records.select(F.explode(roles).alias("r")).select("r.*")


def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The totals of each airport within an Arrow batch."""
    for rows in batches:
        if len(rows):
            late, out = rows["minutes"] > LATE_MINUTES, rows["departing"].astype(bool)
            one = pd.DataFrame({"airport_code": rows["airport_code"], "departures": out, "late_departures": out & late,
                                "departure_minutes": rows["minutes"].where(out, 0), "arrivals": ~out, "late_arrivals": ~out & late,
                                "arrival_minutes": rows["minutes"].where(~out, 0)})
            yield one.groupby("airport_code", as_index=False)[TOTALS].sum().astype({c: "int64" for c in TOTALS})


class AirportTotals(StatefulProcessor):
    """Adds a micro-batch's totals to those of the airport and returns the new ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.totals.get()) if self.totals.exists() else [0] * len(TOTALS)
        for part in rows:
            now = [a + int(b) for a, b in zip(now, part[TOTALS].sum())]
        self.totals.update(tuple(now))
        yield pd.DataFrame([(key[0], *now)], columns=["airport_code", *TOTALS])

    def close(self) -> None:
        pass


def running_totals(pages: DataFrame) -> DataFrame:
    """A stream of pages (page, payload) as a stream of each touched airport's totals so far."""
    partial = role_rows(pages).mapInPandas(add_up, f"airport_code string, {TOTALS_SCHEMA}")
    return partial.groupBy("airport_code").transformWithStateInPandas(
        AirportTotals(), f"airport_code string, {TOTALS_SCHEMA}", "Update", "None")


def run_running_aggregates(pages: DataFrame, out_dir: str, checkpoint_location: str, available_now: bool = True):
    """Keep the aggregates of a stream of pages under ``out_dir``; returns the query (ended if ``available_now``)."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(changed: DataFrame, batch_id: int) -> None:
        # airports are few: one file a micro-batch
        changed.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    writer = (running_totals(pages).writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint_location))
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()
    if available_now:
        query.awaitTermination()
    return query


def read_running_aggregates(spark: SparkSession, out_dir: str) -> DataFrame:
    """The aggregates as of the last micro-batch: (airport_code, the six live airport columns); a role that an
    airport never had is null."""
    schema = f"airport_code string, {TOTALS_SCHEMA}"
    try:
        every = spark.read.schema(f"{schema}, batch bigint").option("basePath", out_dir).parquet(out_dir)
    except AnalysisException:                       # no micro-batch yet
        every = spark.createDataFrame([], f"{schema}, batch bigint")
    last = every.groupBy("airport_code").agg(F.max_by(F.struct(*TOTALS), "batch").alias("t")).select("airport_code", "t.*")

    def of(role: str, column: str):
        return F.when(F.col(role) > 0, F.col(column))
    columns = [of("departures", "departures"), of("arrivals", "arrivals"), of("departures", "late_departures"), of("arrivals", "late_arrivals"),
               of("departures", "departure_minutes") / F.col("departures"), of("arrivals", "arrival_minutes") / F.col("arrivals")]
    return last.select("airport_code", *[c.alias(n) for c, n in zip(columns, LIVE_AIRPORT_COLUMNS)])
