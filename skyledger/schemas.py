"""Canonical star-schema tables and the ``conform`` helper.

One model covers both attribute sets found in the reference: the surrogate-key columns of the
relational schema plus the descriptive attributes of the later live-data loader, as nullable
columns.  Natural keys are listed in ``NATURAL_KEYS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
DT, TS = T.DateType(), T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DIM_AIRLINE = _struct(("airline_id", I), ("airline_code", S), ("airline_name", S))
DIM_AIRPORT = _struct(("airport_id", I), ("airport_code", S), ("airport_name", S), ("city", S),
                      ("state", S), ("country", S), ("latitude", D), ("longitude", D),
                      ("continent", S), ("airport_type", S), ("elevation", D))
DIM_DATE = _struct(("date_id", I), ("full_date", DT), ("year", I), ("month", I), ("day", I),
                   ("quarter", I), ("day_of_week", I), ("is_weekend", B))
DIM_TIME = _struct(("time_id", I), ("time_value", S), ("hour", I), ("minute", I), ("time_of_day", S))
DIM_FLIGHT = _struct(("flight_id", I), ("flight_number", S), ("flight_type", S),
                     ("route_category", S), ("route_distance", D))
DIM_AIRCRAFT = _struct(("aircraft_id", I), ("aircraft_type", S), ("tail_number", S),
                       ("aircraft_model", S), ("manufacturer", S), ("seating_capacity", I),
                       ("aircraft_category", S))
DIM_WEATHER = _struct(("weather_condition_id", I), ("weather_condition", S), ("temperature", D),
                      ("wind_speed", D), ("visibility", D))
DIM_DELAY_CAUSE = _struct(("delay_cause_id", I), ("delay_cause", S), ("delay_cause_detail", S),
                          ("is_controllable", B))

FACT_KEY = ["flight_id", "date_id", "scheduled_departure_time_id", "origin_airport_id",
            "destination_airport_id"]
FACT_UPDATE_COLUMNS = ["actual_departure_time_id", "weather_condition_id", "delay_cause_id",
                       "delay_minutes", "is_delayed"]
FACT_FLIGHTPERFORMANCE = _struct(
    ("flight_performance_id", L),
    ("flight_id", I), ("airline_id", I), ("origin_airport_id", I), ("destination_airport_id", I),
    ("date_id", I), ("scheduled_departure_time_id", I), ("actual_departure_time_id", I),
    ("aircraft_id", I), ("weather_condition_id", I), ("delay_cause_id", I),
    ("delay_minutes", I), ("is_delayed", B), ("created_at", TS), ("updated_at", TS),
    # live-data attributes (NULL for historical rows)
    ("delay_status", S), ("cancellation_flag", B), ("passengers", I),
    ("scheduled_departure_datetime", TS), ("actual_departure_datetime", TS),
    ("scheduled_arrival_datetime", TS), ("actual_arrival_datetime", TS),
    ("api_source", S), ("api_pull_timestamp", TS), ("api_live_flight_status", S),
    ("api_departure_delay_minutes", I), ("api_arrival_delay_minutes", I),
    ("api_origin_live_departures_count", I), ("api_destination_live_arrivals_count", I),
    # physical partition column: yyyymm of the flight date
    ("flight_month", I),
)

TABLES = {
    "dim_airline": DIM_AIRLINE,
    "dim_airport": DIM_AIRPORT,
    "dim_date": DIM_DATE,
    "dim_time": DIM_TIME,
    "dim_flight": DIM_FLIGHT,
    "dim_aircraft": DIM_AIRCRAFT,
    "dim_weather_condition": DIM_WEATHER,
    "dim_delay_cause": DIM_DELAY_CAUSE,
    "fact_flightperformance": FACT_FLIGHTPERFORMANCE,
}

# table -> (surrogate id column, natural key column)
NATURAL_KEYS = {
    "dim_airline": ("airline_id", "airline_code"),
    "dim_airport": ("airport_id", "airport_code"),
    "dim_date": ("date_id", "full_date"),
    "dim_time": ("time_id", "time_value"),
    "dim_flight": ("flight_id", "flight_number"),
    "dim_aircraft": ("aircraft_id", "aircraft_type"),
    "dim_weather_condition": ("weather_condition_id", "weather_condition"),
    "dim_delay_cause": ("delay_cause_id", "delay_cause"),
}

# fact foreign key -> dimension table
FACT_REFERENCES = {
    "flight_id": "dim_flight",
    "airline_id": "dim_airline",
    "origin_airport_id": "dim_airport",
    "destination_airport_id": "dim_airport",
    "date_id": "dim_date",
    "scheduled_departure_time_id": "dim_time",
    "actual_departure_time_id": "dim_time",
    "aircraft_id": "dim_aircraft",
    "weather_condition_id": "dim_weather_condition",
    "delay_cause_id": "dim_delay_cause",
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Select ``schema``'s columns in order: existing ones cast, missing ones filled with the
    given default (or a typed NULL).  Extra columns are dropped.  Pure projection, no shuffle."""
    defaults = defaults or {}
    present = {c.lower(): c for c in df.columns}
    cols: list[Column] = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        if src is not None:
            cols.append(F.col(f"`{src}`").cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required names that ``df`` lacks (case-sensitive, as the model contract is)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} needs columns that are absent: {', '.join(missing)}")


def empty_table(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def lower_case_columns(df: DataFrame) -> DataFrame:
    """Rename every column to lower case (raw CSV headers arrive upper-case)."""
    return df.toDF(*[c.lower() for c in df.columns])
