"""Golden vectors for the scalar rules."""

import datetime as dt

from pyspark.sql import functions as F

from skyledger.functions import calendar as C
from skyledger.functions import clock as K
from skyledger.functions import flags as FL
from skyledger.functions import text as T


def _eval(spark, values, fn, dtype):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_hhmm_clock_numeric(spark):
    vals = [5, 0, 1430, 2359, 2400, None, 1275, 12345, -5, 2460]
    got = _eval(spark, vals, K.hhmm_to_time, "bigint")
    assert got == ["00:05:00", "00:00:00", "14:30:00", "23:59:00", "23:59:00", None, None, None, None, "23:59:00"]


def test_hhmm_clock_double_and_text(spark):
    assert _eval(spark, [5.0, 5.7, float("nan")], lambda c: K.hhmm_to_time(c, "double"), "double") == \
        ["00:05:00", "00:05:00", None]
    assert _eval(spark, ["abc", "5.0", " 930 ", None], lambda c: K.hhmm_to_time(c, "string"), "string") == \
        [None, None, "09:30:00", None]


def test_part_of_day(spark):
    vals = [4, 5, 11, 12, 16, 17, 20, 21, None]
    assert _eval(spark, vals, K.part_of_day, "int") == \
        ["Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night", "Unknown"]


def test_weekday_conventions(spark):
    days = [dt.date(2024, 1, 15), dt.date(2024, 1, 13), dt.date(2024, 1, 14)]
    assert _eval(spark, days, C.weekday_mon0, "date") == [0, 5, 6]
    assert _eval(spark, days, C.weekday_sun0, "date") == [1, 6, 0]
    assert _eval(spark, days, C.is_weekend, "date") == [False, True, True]


def test_safe_date(spark):
    df = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (None, 1, 1)], "y int, m int, d int")
    assert [r[0] for r in df.select(C.safe_date("y", "m", "d")).collect()] == [dt.date(2024, 2, 29), None, None]


def test_delay_rules(spark):
    vals = [15.0, 15.5, 16.0, None, -3.0, float("nan")]
    assert _eval(spark, vals, FL.is_delayed, "double") == [False, True, True, False, False, False]
    assert _eval(spark, [None, 2.9, -2.9], FL.delay_minutes, "double") == [0, 2, -2]


def test_flight_number_pattern(spark):
    vals = ["AA123", " ual9 ", "F9123", "B6100", "98", "AA12345", None]
    assert _eval(spark, vals, T.is_valid_flight_number, "string") == [True, True, False, False, False, False, False]


def test_unicode_strip(spark):
    assert _eval(spark, ["  ags ", " x "], T.clean_code, "string") == ["AGS", "X"]


def test_time_flags_and_routes(spark):
    df = spark.createDataFrame([(5,), (6,), (12,), (18,), (None,)], "h int")
    rows = df.select(*FL.time_flags("h")).collect()
    assert [tuple(r)[:4] for r in rows] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)]
    d = spark.createDataFrame([(499.9,), (500.0,), (1500.0,), (1500.1,), (None,)], "x double")
    assert [tuple(r) for r in d.select(*FL.route_flags("x")).collect()] == \
        [(1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_quarter_from_month(spark):
    assert _eval(spark, [1, 3, 4, 12, None], C.quarter_from_month, "int") == [1, 1, 2, 4, 1]


def test_iso_wallclock(spark):
    vals = ["2024-01-15T10:20:30+05:00", "2024-01-15T10:20:30Z", "bad", None]
    got = _eval(spark, vals, K.iso_wallclock, "string")
    assert got[:2] == [dt.datetime(2024, 1, 15, 10, 20, 30)] * 2 and got[2:] == [None, None]
    assert _eval(spark, vals, K.iso_time_of_day, "string") == ["10:20:30", "10:20:30", None, None]


def test_to_number(spark):
    assert _eval(spark, ["", "x", "3.5", None], FL.to_number, "string") == [0.0, 0.0, 3.5, 0.0]


def test_to_number_typed_equals_text_path(spark):
    """The direct cast for integral / double / decimal columns gives what the text path gives."""
    for dtype, values in [("int", [1, -7, None]), ("bigint", [2**40, None]),
                          ("double", [0.1, 1e-300, 123456.789, float("nan"), float("inf"), None]),
                          ("decimal(10,3)", [None])]:
        typed = _eval(spark, values, lambda c, t=dtype: FL.to_number(c, t), dtype)
        text = _eval(spark, values, FL.to_number, dtype)
        assert typed == text, dtype
