"""Delay rules and the 0/1 feature flags used by the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference rules).
DELAY_THRESHOLD_MINUTES = 15          # delayed when minutes > 15 (strict)
STATUS_DELAYED = "Delayed"
STATUS_ON_TIME = "On Time"
NIGHT_HOURS = (0, 5)                  # inclusive ranges
MORNING_HOURS = (6, 11)
AFTERNOON_HOURS = (12, 17)
EVENING_HOURS = (18, 23)
PEAK_HOURS = (7, 8, 9, 16, 17, 18, 19)
WINTER_MONTHS = (12, 1, 2)
SUMMER_MONTHS = (6, 7, 8)
HOLIDAY_MONTHS = (12, 1)
LOW_VISIBILITY_BELOW = 5
HIGH_WIND_ABOVE = 20
BAD_WEATHER_TYPES = ("Rain", "Storm", "Snow", "Fog", "Thunderstorm")
SHORT_ROUTE_BELOW = 500
LONG_ROUTE_ABOVE = 1500


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL (Spark orders NaN above every number, pandas treats it as missing)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


# Types whose direct cast to double equals parsing their text form (float is not among them:
# 0.1f widens to 0.10000000149..., while its text "0.1" parses to 0.1).
_EXACT_TO_DOUBLE = ("tinyint", "smallint", "int", "bigint", "double")


def to_number(c, dtype: str | None = None) -> Column:
    """Coerce anything to double; text that is not a number, NULL and NaN become 0.
    With the column's ``dtype`` known to be integral, double or decimal, the value is cast
    directly instead of being formatted to text and parsed back (same result, far cheaper)."""
    if dtype is not None and (dtype in _EXACT_TO_DOUBLE or dtype.startswith("decimal")):
        return F.coalesce(nan_to_null(_c(c).cast("double")), F.lit(0.0))
    return F.coalesce(nan_to_null(_c(c).cast("string").try_cast("double")), F.lit(0.0))


def is_delayed(delay) -> Column:
    """Delay flag: missing delay counts as 0, delayed when strictly above the threshold."""
    return F.coalesce(nan_to_null(_c(delay)), F.lit(0)) > DELAY_THRESHOLD_MINUTES


def delay_minutes(delay) -> Column:
    """Whole delay minutes: missing -> 0, fractions truncate toward zero."""
    return F.coalesce(nan_to_null(_c(delay)), F.lit(0)).cast("int")


def delay_status(flag) -> Column:
    return F.when(_c(flag), F.lit(STATUS_DELAYED)).otherwise(F.lit(STATUS_ON_TIME))


def as_int(flag) -> Column:
    """Boolean condition -> 0/1 with NULL counted as 0."""
    return F.coalesce(_c(flag), F.lit(False)).cast("int")


def _between(c, bounds):
    return _c(c).between(bounds[0], bounds[1])


def time_flags(hour) -> list[Column]:
    return [
        as_int(_between(hour, NIGHT_HOURS)).alias("is_night_flight"),
        as_int(_between(hour, MORNING_HOURS)).alias("is_morning"),
        as_int(_between(hour, AFTERNOON_HOURS)).alias("is_afternoon"),
        as_int(_between(hour, EVENING_HOURS)).alias("is_evening"),
        as_int(_c(hour).isin(*PEAK_HOURS)).alias("is_peak_hour"),
    ]


def season_flags(month) -> list[Column]:
    return [
        as_int(_c(month).isin(*WINTER_MONTHS)).alias("is_winter"),
        as_int(_c(month).isin(*SUMMER_MONTHS)).alias("is_summer"),
        as_int(_c(month).isin(*HOLIDAY_MONTHS)).alias("is_holiday_season"),
    ]


def _number_or_null(c) -> Column:
    return nan_to_null(_c(c).cast("string").try_cast("double"))


def weather_flags(visibility, wind_speed, weather_type) -> list[Column]:
    return [
        as_int(_number_or_null(visibility) < LOW_VISIBILITY_BELOW).alias("low_visibility"),
        as_int(_number_or_null(wind_speed) > HIGH_WIND_ABOVE).alias("high_wind"),
        as_int(_c(weather_type).isin(*BAD_WEATHER_TYPES)).alias("bad_weather"),
    ]


def route_flags(distance) -> list[Column]:
    d = _number_or_null(distance)
    return [
        as_int(d < SHORT_ROUTE_BELOW).alias("short_route"),
        as_int(d.between(SHORT_ROUTE_BELOW, LONG_ROUTE_ABOVE)).alias("medium_route"),
        as_int(d > LONG_ROUTE_ABOVE).alias("long_route"),
    ]
