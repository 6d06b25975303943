"""Star denormalisation of the fact over its dimensions (every role a LEFT join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import quarter_from_month
from .broadcast import broadcast_if_small

STAR_COLUMNS = [
    "flight_performance_id", "delay_minutes", "is_delayed", "created_at", "updated_at",
    "full_date", "day", "month", "year", "day_of_week", "is_weekend",
    "hour", "minute", "time_of_day",
    "origin_airport_code", "destination_airport_code", "origin_airport_name", "destination_airport_name",
    "airline_code", "airline_name",
    "flight_number", "flight_type", "route_category", "route_distance",
    "aircraft_type", "aircraft_model", "manufacturer", "seating_capacity", "aircraft_category",
    "weather_type", "temperature", "wind_speed", "visibility",
    "delay_cause_type", "delay_cause_detail", "is_controllable",
    "quarter",
]


def _airport_role(dim_airport: DataFrame, prefix: str) -> DataFrame:
    """The airport dimension in one role, every column prefixed (origin_ / destination_)."""
    return dim_airport.select(F.col("airport_id").alias(f"{prefix}_airport_id"),
                              F.col("airport_code").alias(f"{prefix}_airport_code"),
                              F.col("airport_name").alias(f"{prefix}_airport_name"),
                              F.col("city").alias(f"{prefix}_city"),
                              F.col("country").alias(f"{prefix}_country"),
                              F.col("latitude").alias(f"{prefix}_latitude"),
                              F.col("longitude").alias(f"{prefix}_longitude"))


def star_join(tables: dict[str, DataFrame], fact: DataFrame | None = None,
              columns: list[str] | None = None) -> DataFrame:
    """Fact with every dimension attribute attached (LEFT joins: a fact row is never lost).

    Dimensions under the broadcast bound are broadcast, so the fact streams through map-side
    hash joins with no shuffle; filters on fact columns are pushed below the joins by Catalyst.
    With ``columns``, only the dimension roles that supply one of them are joined: every role
    is a LEFT join on a unique surrogate id, so skipping an unused one changes no row, and the
    fact no longer probes (nor size-checks) dimensions the query never reads.
    """
    f = fact if fact is not None else tables["fact_flightperformance"]
    roles = [
        (tables["dim_date"].drop("quarter"), "date_id"),
        (tables["dim_time"].select(F.col("time_id").alias("scheduled_departure_time_id"),
                                   "hour", "minute", "time_of_day"), "scheduled_departure_time_id"),
        (_airport_role(tables["dim_airport"], "origin"), "origin_airport_id"),
        (_airport_role(tables["dim_airport"], "destination"), "destination_airport_id"),
        (tables["dim_airline"], "airline_id"),
        (tables["dim_flight"], "flight_id"),
        (tables["dim_aircraft"], "aircraft_id"),
        (tables["dim_weather_condition"].withColumnRenamed("weather_condition", "weather_type"),
         "weather_condition_id"),
        (tables["dim_delay_cause"].withColumnRenamed("delay_cause", "delay_cause_type"), "delay_cause_id"),
    ]
    wanted = None if columns is None else set(columns) | ({"month"} if "quarter" in columns else set())
    out = f
    for dim, key in roles:
        if wanted is not None and not (set(dim.columns) - {key}) & wanted:
            continue
        out = out.join(broadcast_if_small(dim), key, "left")
    if "month" in out.columns and (columns is None or "quarter" in columns):
        out = out.withColumn("quarter", quarter_from_month("month"))
    return out


def star_lookup(tables: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """The denormalised lookup dataset behind the dashboard and the prediction page
    (``columns``: a subset of ``STAR_COLUMNS``, joining only the dimensions they come from)."""
    cols = list(columns) if columns is not None else STAR_COLUMNS
    return star_join(tables, columns=cols).select(*cols)


def live_rows_report(tables: dict[str, DataFrame], source: str = "Aviationstack", n: int = 10) -> DataFrame:
    """Latest ``n`` live rows (by id) with airline, flight and airport codes attached."""
    # every join below is LEFT on a unique id, so the ten rows can be taken first
    f = (tables["fact_flightperformance"].where(F.col("api_source") == source)
         .orderBy(F.desc("flight_performance_id")).limit(n))
    al = tables["dim_airline"].select("airline_id", "airline_code", "airline_name")
    fl = tables["dim_flight"].select("flight_id", "flight_number")
    airport = lambda role: tables["dim_airport"].select(
        F.col("airport_id").alias(f"{role}_airport_id"), F.col("airport_code").alias(f"{role}_airport"))
    j = (f.join(al, "airline_id", "left").join(fl, "flight_id", "left")
         .join(airport("origin"), "origin_airport_id", "left").join(airport("destination"), "destination_airport_id", "left"))
    return j.select("flight_performance_id", "airline_code", "airline_name", "flight_number",
                    "origin_airport", "destination_airport", "delay_minutes", "delay_status",
                    "api_source", "api_live_flight_status", "api_departure_delay_minutes",
                    "api_arrival_delay_minutes", "api_origin_live_departures_count",
                    "api_destination_live_arrivals_count") \
        .orderBy(F.desc("flight_performance_id"))
