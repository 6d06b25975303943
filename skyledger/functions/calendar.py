"""Calendar expressions: date parts, weekday conventions, safe date construction, smart keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekend days under the Monday=0 convention.
WEEKEND_MON0 = (5, 6)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def safe_date(year, month, day) -> Column:
    """Date from parts; an impossible date is NULL (quarantined) instead of aborting the batch.
    Parts of the usual widths are padded; formatting, which costs far more, is left for the others."""
    y, m, d = _c(year), _c(month), _c(day)
    usual = y.between(0, 9999) & m.between(0, 99) & d.between(0, 99)
    padded = F.concat_ws("-", *[F.lpad(c.cast("string"), n, "0") for c, n in ((y, 4), (m, 2), (d, 2))])
    text = F.when(usual, padded).otherwise(F.format_string("%04d-%02d-%02d", y, m, d))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def weekday_mon0(d) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def weekday_sun0(d) -> Column:
    """Day of week with Sunday = 0 ... Saturday = 6 (the SQL DOW convention)."""
    return F.dayofweek(_c(d)) - 1


def is_weekend(d) -> Column:
    return weekday_mon0(d).isin(*WEEKEND_MON0)


def quarter_from_month(month) -> Column:
    """Quarter 1..4 from a month number; a missing month counts as quarter 1."""
    m = _c(month)
    return F.coalesce((F.floor((m - 1) / 3) + 1).cast("int"), F.lit(1))


def calendar_columns(d) -> list[Column]:
    """year, month, day, quarter, day_of_week (Mon=0), is_weekend of a date column."""
    d = _c(d)
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.quarter(d).alias("quarter"),
        weekday_mon0(d).alias("day_of_week"),
        is_weekend(d).alias("is_weekend"),
    ]


def smart_date_key(d) -> Column:
    """yyyymmdd integer key of a date or timestamp."""
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def smart_time_key(ts) -> Column:
    """hhmm integer key of a timestamp."""
    ts = _c(ts)
    return (F.hour(ts) * 100 + F.minute(ts)).cast("int")
