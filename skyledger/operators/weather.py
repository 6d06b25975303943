"""Nearest-hour weather enrichment with defaults for missing payloads or metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.weather_json import WEATHER_METRICS


def nearest_hour_weather(requests: DataFrame, hourly: DataFrame, hour_col: str = "scheduled_hour") -> DataFrame:
    """For each request (airport_code, date, hour): the reading whose hour is closest to the
    requested hour (ties -> the earlier hour).  Requests without any reading for their airport
    and date get every metric 0.0; a metric the payload lacked is 0.0 as well.

    Plan: on the reading side each (airport, date) becomes 24 rows, the nearest reading for every
    hour (at most 24 readings each, one small aggregation); requests then meet exactly one row
    through an equi-join on (airport_code, date, hour), with no fan-out and no second join.
    """
    w = hourly.select("airport_code", "date", F.struct("reading_hour", *WEATHER_METRICS).alias("_r"))
    wanted = w.withColumn("_want", F.explode(F.sequence(F.lit(0), F.lit(23))))
    by_hour = wanted.groupBy("airport_code", "date", "_want").agg(F.min_by(
        "_r", F.struct(F.abs(F.col("_r.reading_hour") - F.col("_want")).alias("d"), F.col("_r.reading_hour").alias("h"))).alias("_w"))
    r = requests.withColumn("_want", F.col(hour_col).cast("int"))
    return r.join(by_hour, ["airport_code", "date", "_want"], "left").select(
        *requests.columns, F.col("_w.reading_hour").alias("matched_hour"),
        *[F.coalesce(F.col(f"_w.{m}").cast("double"), F.lit(0.0)).alias(m) for m in WEATHER_METRICS])
