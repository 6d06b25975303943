"""Hourly weather payloads (a struct of parallel arrays per airport and date) -> rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The hourly metrics of a weather payload (reference field names and order).
WEATHER_METRICS = ["temperature_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall",
                   "weather_code", "wind_speed_10m", "wind_gusts_10m"]

HOURLY = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))] +
                      [T.StructField(m, T.ArrayType(T.DoubleType())) for m in WEATHER_METRICS])
PAYLOAD = T.StructType([T.StructField("airport_code", T.StringType()),
                        T.StructField("date", T.StringType()),
                        T.StructField("hourly", HOURLY)])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files (JSON Lines, one payload per airport-date)."""
    return spark.read.schema(PAYLOAD).json(path)


def parse_payload_text(df: DataFrame, text_col: str = "payload") -> DataFrame:
    return df.select(F.from_json(F.col(text_col), PAYLOAD).alias("p")).select("p.*")


def hourly_rows(payloads: DataFrame) -> DataFrame:
    """One row per (airport, date, reading): ``inline(arrays_zip(...))`` walks the parallel
    arrays in one pass (shorter arrays pad with NULL).  A payload without ``hourly`` or with an
    empty ``time`` array yields no rows (so lookups fall back to defaults)."""
    # a metric the payload lacks is a NULL array, which would null the whole zip: use [] so
    # the zip pads it with NULLs instead
    empty = F.array().cast("array<double>")
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"),
                          *[F.coalesce(F.col(f"hourly.{m}"), empty).alias(m) for m in WEATHER_METRICS])
    rows = payloads.where(F.col("hourly").isNotNull()).select(
        "airport_code", F.col("date").cast("date").alias("date"), F.inline(zipped))
    ts = F.col("time").try_cast("timestamp_ntz")
    return rows.withColumn("reading_hour", F.hour(ts)).where(F.col("time").isNotNull())
