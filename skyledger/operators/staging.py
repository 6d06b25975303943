"""Historical flight rows -> staged fact rows (cleaned clocks, flags, default members)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import safe_date
from ..functions.clock import hhmm_to_time
from ..functions.flags import delay_minutes, is_delayed

# Members every historical row points at (reference rules).
DEFAULT_AIRCRAFT = "Unknown"
DEFAULT_WEATHER = "Unknown"
DEFAULT_DELAY_CAUSE = "None"
UNKNOWN = "Unknown"


def _kind(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    return "numeric"


def _flight_number_text(df: DataFrame) -> F.Column:
    # A numeric column holding flight numbers prints as an integer ("98", never "98.0").
    c = F.col("flight_number")
    if _kind(df, "flight_number") == "string":
        return c
    return c.cast("bigint").cast("string")


def stage_flights(flights: DataFrame, order_cols: list[str]) -> DataFrame:
    """One staged row per raw flight: natural keys with 'Unknown' defaults, flight date,
    scheduled / actual 'HH:MM:SS', whole delay minutes, delay flag, the three default members,
    the yyyymm partition value, and the ordinal columns."""
    sched_kind, actual_kind = _kind(flights, "scheduled_departure"), _kind(flights, "departure_time")
    # dates and clocks first: what reads one of them several times doesn't compute it again
    flights = flights.withColumns({
        "_date": safe_date("year", "month", "day"),
        "_scheduled": hhmm_to_time("scheduled_departure", sched_kind),
        "_actual": hhmm_to_time("departure_time", actual_kind),
    })
    flight_date = F.col("_date")
    return flights.select(
        *order_cols,
        _flight_number_text(flights).alias("flight_number"),
        F.coalesce(F.col("airline").cast("string"), F.lit(UNKNOWN)).alias("airline_code"),
        F.coalesce(F.col("origin_airport").cast("string"), F.lit(UNKNOWN)).alias("origin_airport_code"),
        F.coalesce(F.col("destination_airport").cast("string"), F.lit(UNKNOWN)).alias("destination_airport_code"),
        flight_date.alias("flight_date"),
        F.col("_scheduled").alias("scheduled_departure_time"),
        F.col("_actual").alias("actual_departure_time"),
        delay_minutes("departure_delay").alias("delay_minutes"),
        is_delayed("departure_delay").alias("is_delayed"),
        F.lit(DEFAULT_AIRCRAFT).alias("aircraft_type"),
        F.lit(DEFAULT_WEATHER).alias("weather_condition"),
        F.lit(DEFAULT_DELAY_CAUSE).alias("delay_cause"),
        (F.year(flight_date) * 100 + F.month(flight_date)).alias("flight_month"),
        (F.col("scheduled_departure").isNotNull() & F.col("_scheduled").isNull()).alias("_bad_scheduled"),
        (F.col("departure_time").isNotNull() & F.col("_actual").isNull()).alias("_bad_actual"),
        (flight_date.isNull() & F.col("year").isNotNull()).alias("_bad_date"),
    )


def malformed_rows(staged: DataFrame) -> DataFrame:
    """Staged rows whose clock or date text could not be read (quarantine with a reason)."""
    reason = (F.when(F.col("_bad_date"), F.lit("invalid flight date"))
              .when(F.col("_bad_scheduled"), F.lit("malformed scheduled_departure"))
              .when(F.col("_bad_actual"), F.lit("malformed departure_time")))
    return staged.where(F.col("_bad_date") | F.col("_bad_scheduled") | F.col("_bad_actual")) \
        .withColumn("reason", reason)
