"""Time-of-day expressions: HHMM clocks, parts of day, ISO timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part-of-day buckets on the hour, [start, end) -> label (reference rule).
PART_OF_DAY = (
    (5, 12, "Morning"),
    (12, 17, "Afternoon"),
    (17, 21, "Evening"),
)
PART_OF_DAY_OTHER = "Night"
PART_OF_DAY_MISSING = "Unknown"

_INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _integral(c: Column, source_type: str) -> Column:
    """Integer value of a clock reading; non-integral text is NULL, floats truncate toward zero."""
    if source_type == "string":
        return F.when(c.rlike(_INTEGER_TEXT), F.trim(c).try_cast("bigint"))
    if source_type in ("float", "double"):
        return F.when(~F.isnan(c), c.try_cast("bigint"))
    return c.cast("bigint")


def hhmm_to_time(c: Column | str, source_type: str = "numeric") -> Column:
    """HHMM clock (e.g. 1430) -> 'HH:MM:00'.

    Hours of 24 or more clamp to 23:59.  Readings that cannot be a clock (negative, more than four
    digits, minute >= 60) become NULL so they can be quarantined instead of failing a batch.
    """
    c = F.col(c) if isinstance(c, str) else c
    v = _integral(c, source_type)
    hour = F.floor(v / 100).cast("int")
    minute = (v % 100).cast("int")
    return (
        F.when(v.isNull() | (v < 0) | (v > 9999), F.lit(None).cast("string"))
        .when(hour >= 24, F.lit("23:59:00"))
        .when(minute >= 60, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00")))
    )


def hhmm_is_malformed(c: Column | str, source_type: str = "numeric") -> Column:
    """TRUE when a non-NULL clock reading could not be turned into a time (quarantine reason)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & hhmm_to_time(c, source_type).isNull()


def part_of_day(hour: Column | str) -> Column:
    """Morning / Afternoon / Evening / Night from an hour; NULL -> Unknown."""
    hour = F.col(hour) if isinstance(hour, str) else hour
    expr = F.when(hour.isNull(), F.lit(PART_OF_DAY_MISSING))
    for start, end, label in PART_OF_DAY:
        expr = expr.when((hour >= start) & (hour < end), F.lit(label))
    return expr.otherwise(F.lit(PART_OF_DAY_OTHER))


def time_hour(time_value: Column | str) -> Column:
    """Hour of a 'HH:MM:SS' string."""
    t = F.col(time_value) if isinstance(time_value, str) else time_value
    return F.substring(t, 1, 2).try_cast("int")


def time_minute(time_value: Column | str) -> Column:
    """Minute of a 'HH:MM:SS' string."""
    t = F.col(time_value) if isinstance(time_value, str) else time_value
    return F.substring(t, 4, 2).try_cast("int")


def iso_wallclock(c: Column | str, fill: Column | None = None) -> Column:
    """ISO-8601 text (with 'Z' or an offset) -> timestamp_ntz keeping the written wall clock.

    Invalid or missing text is NULL, or ``fill`` (e.g. the run timestamp) when given.
    """
    c = F.col(c) if isinstance(c, str) else c
    parsed = F.trim(c).try_cast("timestamp_ntz")
    return F.coalesce(parsed, fill) if fill is not None else parsed


def iso_time_of_day(c: Column | str) -> Column:
    """ISO-8601 text -> 'HH:mm:ss' of its wall clock; invalid -> NULL."""
    return F.date_format(iso_wallclock(c), "HH:mm:ss")
