"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator group,
each with the DuckDB SQL that must give the same rows (when SQL can express it)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .operators import analytics as A
from .operators import dims as D
from .operators.broadcast import broadcast_if_small
from .operators.features import DELAY_RATE_GROUPS
from .operators.ids import key_watermarks
from .operators.star import star_lookup
from .plans.warehouse import source_signature, testbed_load, warehouse_for
from .schemas import NATURAL_KEYS
from .session import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _dash(spark, sf_dir, *need):
    """The dashboard frame over a star holding only what the chart needs: id, flag, date parts
    and airline name (the filters) plus ``need``; unused dimension roles are never joined."""
    cols = ["flight_performance_id", "is_delayed", "full_date", "year", "month", "airline_name", *need]
    return A.dashboard_frame(star_lookup(warehouse_for(spark, sf_dir), cols))


# ---------------------------------------------------------------- dimensions

@register("dim_airline_first_wins", O.WAREHOUSE + "SELECT * FROM dim_airline")
def q_dim_airline(spark, sf_dir):
    return warehouse_for(spark, sf_dir)["dim_airline"]


@register("dim_airport_conform", O.WAREHOUSE + "SELECT * FROM dim_airport")
def q_dim_airport(spark, sf_dir):
    return warehouse_for(spark, sf_dir)["dim_airport"]


@register("dim_date_build", O.WAREHOUSE + "SELECT * FROM dim_date")
def q_dim_date(spark, sf_dir):
    return warehouse_for(spark, sf_dir)["dim_date"]


@register("dim_time_build", O.WAREHOUSE + "SELECT * FROM dim_time")
def q_dim_time(spark, sf_dir):
    return warehouse_for(spark, sf_dir)["dim_time"]


@register("dim_flight_build", O.WAREHOUSE + "SELECT * FROM dim_flight")
def q_dim_flight(spark, sf_dir):
    return warehouse_for(spark, sf_dir)["dim_flight"]


_STATIC = {"dim_aircraft": "aircraft_id", "dim_weather_condition": "weather_condition_id", "dim_delay_cause": "delay_cause_id"}


@register("dim_static_members", O.WAREHOUSE + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS member_id, {NATURAL_KEYS[t][1]} AS member, "
    f"(SELECT count(*) FROM fact WHERE fact.{i} = {t}.{i}) AS fact_rows FROM {t}" for t, i in _STATIC.items()))
def q_static(spark, sf_dir):
    """The seeded members, and how many fact rows use each: one pass over the fact's three keys."""
    return D.member_usage(warehouse_for(spark, sf_dir), _STATIC)


@register("key_watermarks", O.WAREHOUSE + """
SELECT 'dim_airline' AS table_name, CAST(coalesce(max(airline_id), 1) AS BIGINT) AS max_id FROM dim_airline
UNION ALL SELECT 'dim_airport', CAST(coalesce(max(airport_id), 1) AS BIGINT) FROM dim_airport
UNION ALL SELECT 'dim_flight', CAST(coalesce(max(flight_id), 1) AS BIGINT) FROM dim_flight
UNION ALL SELECT 'dim_weather_condition', CAST(coalesce(max(weather_condition_id), 1) AS BIGINT) FROM dim_weather_condition
UNION ALL SELECT 'dim_aircraft', CAST(coalesce(max(aircraft_id), 1) AS BIGINT) FROM dim_aircraft
UNION ALL SELECT 'dim_delay_cause', CAST(coalesce(max(delay_cause_id), 1) AS BIGINT) FROM dim_delay_cause
UNION ALL SELECT 'fact_flightperformance', CAST(coalesce(max(flight_performance_id), 1) AS BIGINT) FROM fact""")
def q_watermarks(spark, sf_dir):
    wh = warehouse_for(spark, sf_dir)
    ids = {t: NATURAL_KEYS[t][0] for t in ("dim_airline", "dim_airport", "dim_flight", "dim_weather_condition",
                                           "dim_aircraft", "dim_delay_cause")}
    ids["fact_flightperformance"] = "flight_performance_id"
    return key_watermarks(wh, ids)


# ---------------------------------------------------------------- fact build

_STAGED_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "flight_number",
                "airline_code", "origin_airport_code", "destination_airport_code", "flight_date",
                "scheduled_departure_time", "actual_departure_time", "delay_minutes", "is_delayed",
                "aircraft_type", "weather_condition", "delay_cause"]


@register("fact_projection", O.with_ctes(O.FLIGHTS, O.STG) + "SELECT * FROM stg")
def q_fact_projection(spark, sf_dir):
    from .operators.staging import stage_flights
    from .sources import testbed
    return stage_flights(testbed.flights_raw(spark, sf_dir), testbed.FLIGHT_ORDINAL).select(*_STAGED_COLS)


@register("fact_table", O.WAREHOUSE + """
SELECT flight_performance_id, flight_id, airline_id, origin_airport_id, destination_airport_id, date_id,
  scheduled_departure_time_id, actual_departure_time_id, aircraft_id, weather_condition_id, delay_cause_id,
  delay_minutes, is_delayed, flight_month FROM fact""")
def q_fact_table(spark, sf_dir):
    return warehouse_for(spark, sf_dir)["fact_flightperformance"].select(
        "flight_performance_id", "flight_id", "airline_id", "origin_airport_id", "destination_airport_id", "date_id",
        "scheduled_departure_time_id", "actual_departure_time_id", "aircraft_id", "weather_condition_id",
        "delay_cause_id", "delay_minutes", "is_delayed", "flight_month")


@register("fact_unresolved", O.with_ctes(O.FLIGHTS, O.STG, O.DIMS) + """
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, s.l_shipdate, s.flight_number,
  s.scheduled_departure_time
FROM stg s
LEFT JOIN dim_flight f ON f.flight_number = s.flight_number
LEFT JOIN dim_airline a ON a.airline_code = s.airline_code
LEFT JOIN dim_airport o ON o.airport_code = s.origin_airport_code
LEFT JOIN dim_airport d ON d.airport_code = s.destination_airport_code
LEFT JOIN dim_date dd ON dd.full_date = s.flight_date
LEFT JOIN dim_time st ON st.time_value = s.scheduled_departure_time
WHERE f.flight_id IS NULL OR a.airline_id IS NULL OR o.airport_id IS NULL OR d.airport_id IS NULL
   OR dd.date_id IS NULL OR st.time_id IS NULL""")
def q_fact_unresolved(spark, sf_dir):
    r = testbed_load(spark, sf_dir)
    return r.unresolved.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                               "flight_number", "scheduled_departure_time")


@register("load_counters", O.WAREHOUSE + """
SELECT 'inserted' AS status, CAST(count(*) AS BIGINT) AS rows FROM fact
UNION ALL SELECT 'updated', CAST((SELECT count(*) FROM resolved) - (SELECT count(*) FROM fact) AS BIGINT)
UNION ALL SELECT 'skipped', CAST((SELECT count(*) FROM stg) - (SELECT count(*) FROM resolved) AS BIGINT)""")
def q_load_counters(spark, sf_dir):
    return testbed_load(spark, sf_dir).counters()


# ---------------------------------------------------------------- star & dashboard

@register("star_lookup", O.STARRED + "SELECT * FROM star")
def q_star_lookup(spark, sf_dir):
    return star_lookup(warehouse_for(spark, sf_dir))


@register("kpi_summary", O.with_ctes(O.FLIGHTS, O.STG, O.DIMS, O.RESOLVED, O.FACT, O.STAR) + """
SELECT CAST(count(*) AS BIGINT) AS total_flights,
  CAST(coalesce(sum(CAST(is_delayed AS BIGINT)), 0) AS BIGINT) AS delayed_flights,
  CASE WHEN count(*) > 0 THEN coalesce(sum(CAST(is_delayed AS BIGINT)), 0) / count(*) * 100 ELSE 0.0 END AS delay_rate,
  avg(departure_delay) AS avg_departure_delay
FROM dash WHERE year IS NOT NULL AND airline_name IS NOT NULL""")
def q_kpi(spark, sf_dir):
    return A.kpi_summary(A.apply_filters(_dash(spark, sf_dir, "delay_minutes")))


@register("delay_by_airline", O.STARRED + """
SELECT airline_name, CAST(count(flight_performance_id) AS BIGINT) AS total_flights,
  CAST(sum(CAST(is_delayed AS BIGINT)) AS BIGINT) AS delayed_flights,
  sum(CAST(is_delayed AS BIGINT)) / count(flight_performance_id) * 100 AS delay_rate
FROM dash WHERE year IS NOT NULL AND airline_name IS NOT NULL GROUP BY airline_name""")
def q_delay_by_airline(spark, sf_dir):
    return A.delay_by_airline(A.apply_filters(_dash(spark, sf_dir)))


@register("delay_by_month", O.STARRED + """
SELECT month, CAST(count(flight_performance_id) AS BIGINT) AS total_flights,
  CAST(sum(CAST(is_delayed AS BIGINT)) AS BIGINT) AS delayed_flights,
  avg(departure_delay) AS avg_departure_delay,
  sum(CAST(is_delayed AS BIGINT)) / count(flight_performance_id) * 100 AS delay_rate
FROM dash WHERE year IS NOT NULL AND airline_name IS NOT NULL AND month IS NOT NULL GROUP BY month""")
def q_delay_by_month(spark, sf_dir):
    return A.delay_by_month(A.apply_filters(_dash(spark, sf_dir, "delay_minutes")))


@register("delay_by_hour", O.STARRED + """
SELECT departure_hour, avg(departure_delay) AS avg_departure_delay
FROM dash WHERE year IS NOT NULL AND airline_name IS NOT NULL AND departure_hour IS NOT NULL
GROUP BY departure_hour""")
def q_delay_by_hour(spark, sf_dir):
    return A.delay_by_hour(A.apply_filters(_dash(spark, sf_dir, "delay_minutes", "hour")))


@register("top_routes", O.STARRED + """
SELECT route, total_flights, avg_departure_delay FROM (
  SELECT coalesce(origin_airport, 'Unknown') || ' → ' || coalesce(destination_airport, 'Unknown') AS route,
    CAST(count(flight_performance_id) AS BIGINT) AS total_flights, avg(departure_delay) AS avg_departure_delay
  FROM dash WHERE year IS NOT NULL AND airline_name IS NOT NULL GROUP BY 1)
WHERE total_flights >= 10 ORDER BY avg_departure_delay DESC, route LIMIT 10""")
def q_top_routes(spark, sf_dir):
    return A.top_routes(A.apply_filters(_dash(spark, sf_dir, "delay_minutes", "origin_airport_code", "destination_airport_code")))


@register("filtered_dashboard", O.STARRED + """
, picks AS (SELECT DISTINCT airline_name FROM dash WHERE airline_name IS NOT NULL ORDER BY airline_name LIMIT 5)
SELECT CAST(count(*) AS BIGINT) AS total_flights,
  CAST(coalesce(sum(CAST(is_delayed AS BIGINT)), 0) AS BIGINT) AS delayed_flights,
  CASE WHEN count(*) > 0 THEN coalesce(sum(CAST(is_delayed AS BIGINT)), 0) / count(*) * 100 ELSE 0.0 END AS delay_rate,
  avg(departure_delay) AS avg_departure_delay
FROM dash WHERE year IS NOT NULL AND airline_name IN (SELECT airline_name FROM picks)""")
def q_filtered_dashboard(spark, sf_dir):
    summary = stored(A.year_airline_summary(_dash(spark, sf_dir, "delay_minutes")), "summary")
    return A.kpis_of_summary(A.apply_filters(summary, airlines=A.default_airlines(summary)))


@register("dashboard_two_years", O.STARRED + """
, years AS (SELECT DISTINCT year FROM dash WHERE year IS NOT NULL ORDER BY year DESC LIMIT 2)
SELECT CAST(count(*) AS BIGINT) AS total_flights,
  CAST(coalesce(sum(CAST(is_delayed AS BIGINT)), 0) AS BIGINT) AS delayed_flights,
  CASE WHEN count(*) > 0 THEN coalesce(sum(CAST(is_delayed AS BIGINT)), 0) / count(*) * 100 ELSE 0.0 END AS delay_rate,
  avg(departure_delay) AS avg_departure_delay
FROM dash WHERE year IN (SELECT year FROM years) AND airline_name IS NOT NULL""")
def q_dashboard_two_years(spark, sf_dir):
    """The KPIs of a chosen subset of years: the two latest."""
    summary = stored(A.year_airline_summary(_dash(spark, sf_dir, "delay_minutes")), "summary")
    latest = A.year_options(summary).orderBy(F.desc("year")).limit(2)
    return A.kpis_of_summary(A.apply_filters(summary, years=latest))


@register("option_lists", O.STARRED + """
SELECT 'year' AS option_kind, CAST(year AS VARCHAR) AS option_value FROM (SELECT DISTINCT year FROM dash WHERE year IS NOT NULL)
UNION ALL SELECT 'airline', airline_name FROM (SELECT DISTINCT airline_name FROM dash WHERE airline_name IS NOT NULL)
UNION ALL SELECT 'flight_number', flight_number FROM (SELECT DISTINCT flight_number FROM dim_flight)""")
def q_option_lists(spark, sf_dir):
    frame = _dash(spark, sf_dir)
    wh = warehouse_for(spark, sf_dir)
    return (A.year_options(frame).select(F.lit("year").alias("option_kind"), F.col("year").cast("string").alias("option_value"))
            .unionByName(A.airline_options(frame).select(F.lit("airline").alias("option_kind"),
                                                         F.col("airline_name").alias("option_value")))
            .unionByName(wh["dim_flight"].select("flight_number").distinct()
                         .select(F.lit("flight_number").alias("option_kind"), F.col("flight_number").alias("option_value"))))


@register("available_flights", O.STARRED + """
SELECT DISTINCT upper(trim(flight_number)) AS flight_number, airline_code, origin_airport_code,
  destination_airport_code, full_date
FROM star WHERE regexp_full_match(upper(trim(flight_number)), '[A-Z]{2,3}[0-9]{1,4}')""")
def q_available_flights(spark, sf_dir):
    return A.available_flights(star_lookup(warehouse_for(spark, sf_dir), [
        "flight_number", "airline_code", "origin_airport_code", "destination_airport_code", "full_date"]))


@register("airline_airport_options", O.WAREHOUSE + """
SELECT 'airline' AS kind, airline_id AS id, airline_code AS code, airline_name AS name FROM dim_airline
UNION ALL SELECT 'airport', airport_id, airport_code, airport_name FROM dim_airport""")
def q_airline_airport_options(spark, sf_dir):
    wh = warehouse_for(spark, sf_dir)
    return (wh["dim_airline"].select(F.lit("airline").alias("kind"), F.col("airline_id").alias("id"),
                                     F.col("airline_code").alias("code"), F.col("airline_name").alias("name"))
            .unionByName(wh["dim_airport"].select(F.lit("airport").alias("kind"), F.col("airport_id").alias("id"),
                                                  F.col("airport_code").alias("code"), F.col("airport_name").alias("name"))))


@register("table_counts", O.WAREHOUSE + """
SELECT 'fact_flightperformance' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM fact
UNION ALL SELECT 'dim_airline', CAST(count(*) AS BIGINT) FROM dim_airline
UNION ALL SELECT 'dim_airport', CAST(count(*) AS BIGINT) FROM dim_airport
UNION ALL SELECT 'dim_date', CAST(count(*) AS BIGINT) FROM dim_date
UNION ALL SELECT 'live_fact_rows', CAST(count(*) AS BIGINT) FROM fact WHERE api_source = 'Aviationstack'""")
def q_table_counts(spark, sf_dir):
    return A.table_counts(warehouse_for(spark, sf_dir))


# ---------------------------------------------------------------- live API ingest

def _live_pages(spark, sf_dir):
    from .sources import testbed
    return testbed.live_pages(spark, sf_dir)


def _once(kept: dict, spark, sf_dir, make):
    """``make()``, once per application and data folder: its parts are stored tables that several keys read."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in kept:
        kept[key] = make()
    return kept[key]


_APPENDED: dict = {}
_UPSERTED: dict = {}


def _appended(spark, sf_dir):
    from .plans.live_update import append_live
    return _once(_APPENDED, spark, sf_dir, lambda: append_live(spark, warehouse_for(spark, sf_dir), _live_pages(spark, sf_dir)))


def _upserted(spark, sf_dir):
    from .plans.live_update import upsert_live
    return _once(_UPSERTED, spark, sf_dir, lambda: upsert_live(spark, warehouse_for(spark, sf_dir), _live_pages(spark, sf_dir)))


_FLAT_OUT = ["page", "pos", "flight_number", "airline_code", "airline_name", "origin_airport_code",
             "origin_airport_name", "destination_airport_code", "destination_airport_name", "live_flight_status",
             "departure_delay_minutes_live", "arrival_delay_minutes_live", "scheduled_departure_datetime",
             "actual_departure_datetime", "scheduled_arrival_datetime", "actual_arrival_datetime",
             "flight_type", "route_category", "route_distance"]
_LIVE_SQL = O.with_ctes(O.FLIGHTS, O.LIVE_FLAT)


@register("live_flatten", _LIVE_SQL + "SELECT " + ", ".join(_FLAT_OUT) + " FROM live_flat WHERE _keep")
def q_live_flatten(spark, sf_dir):
    from .sources.live_json import flatten_pages
    return flatten_pages(_live_pages(spark, sf_dir)).select(*_FLAT_OUT)


@register("live_reject", _LIVE_SQL + "SELECT page, pos, flight_number, reason FROM live_tagged WHERE reason IS NOT NULL")
def q_live_reject(spark, sf_dir):
    from .plans.live_update import parse_batch
    return parse_batch(_live_pages(spark, sf_dir)).rejected.select("page", "pos", "flight_number", "reason")


@register("live_pages_capped", _LIVE_SQL + """
SELECT page, pos, flight_number FROM live_flat WHERE _keep ORDER BY page, pos LIMIT 500""")
def q_live_pages_capped(spark, sf_dir):
    from .sources.live_json import cap_kept, flatten_pages
    # the pull's own stopping rule (max kept rows, reference default 500) is the feature here
    return cap_kept(flatten_pages(_live_pages(spark, sf_dir)), 500).select("page", "pos", "flight_number")


@register("live_parse_times", _LIVE_SQL + """
SELECT page, pos, flight_date, scheduled_departure_time, actual_departure_time, delay_minutes, is_delayed,
  scheduled_departure_datetime, actual_departure_datetime FROM live_acc""")
def q_live_parse_times(spark, sf_dir):
    from .plans.live_update import parse_batch
    return parse_batch(_live_pages(spark, sf_dir)).accepted.select(
        "page", "pos", "flight_date", "scheduled_departure_time", "actual_departure_time", "delay_minutes",
        "is_delayed", "scheduled_departure_datetime", "actual_departure_datetime")


_LIVE_UPSERT_SQL = O.with_ctes(O.FLIGHTS, O.STG, O.DIMS, O.RESOLVED, O.FACT, O.LIVE_FLAT, O.LIVE_DIMS)
_MERGED_COLS = ["flight_performance_id", "flight_id", "airline_id", "origin_airport_id", "destination_airport_id",
                "date_id", "scheduled_departure_time_id", "actual_departure_time_id", "aircraft_id",
                "weather_condition_id", "delay_cause_id", "delay_minutes", "is_delayed", "flight_month"]


@register("live_upsert_rows", _LIVE_UPSERT_SQL + "SELECT * EXCLUDE (n_rows) FROM live_merged")
def q_live_upsert_rows(spark, sf_dir):
    from .plans.live_update import upsert_live
    from .schemas import FACT_FLIGHTPERFORMANCE
    r = upsert_live(spark, warehouse_for(spark, sf_dir), _live_pages(spark, sf_dir))
    # inserted / updated rows straight from the stored merge (no join of affected to statuses)
    changed = r.merge.merged.where(F.col("_status") != "unchanged")
    return changed.select(*[F.col(c).cast(FACT_FLIGHTPERFORMANCE[c].dataType).alias(c) for c in _MERGED_COLS],
                          F.col("_status").alias("status"))


@register("live_upsert_status", _LIVE_UPSERT_SQL + """
SELECT 'inserted' AS status, CAST(count(*) FILTER (WHERE status = 'inserted') AS BIGINT) AS rows FROM live_merged
UNION ALL SELECT 'updated', CAST(coalesce(sum(CASE WHEN status = 'updated' THEN n_rows ELSE n_rows - 1 END), 0) AS BIGINT) FROM live_merged
UNION ALL SELECT 'skipped', CAST((SELECT count(*) FROM live_tagged WHERE reason IS NOT NULL)
  + (SELECT count(*) FROM live_acc) - (SELECT count(*) FROM live_resolved) AS BIGINT)""")
def q_live_upsert_status(spark, sf_dir):
    return _upserted(spark, sf_dir).counters()


_APPEND_SQL = O.with_ctes(O.FLIGHTS, O.STG, O.DIMS, O.RESOLVED, O.FACT, O.LIVE_FLAT) + """
, named AS (
  SELECT airline_code, airline_name FROM (
    SELECT airline_code, airline_name, row_number() OVER (PARTITION BY airline_code ORDER BY page DESC, pos DESC) AS rn
    FROM live_acc WHERE airline_name IS NOT NULL) WHERE rn = 1
), airline_after AS (
  SELECT a.airline_id, a.airline_code, coalesce(n.airline_name, a.airline_name) AS airline_name
  FROM dim_airline a LEFT JOIN named n USING (airline_code)
), appended AS (
  SELECT CAST((SELECT max(flight_performance_id) FROM fact) + row_number() OVER (ORDER BY s.page, s.pos) AS BIGINT)
      AS flight_performance_id,
    s.*, a.airline_id
  FROM live_acc s
  JOIN dim_flight f ON f.flight_number = s.flight_number
  JOIN airline_after a ON a.airline_code = s.airline_code
  JOIN dim_airport o ON o.airport_code = s.origin_airport_code
  JOIN dim_airport d ON d.airport_code = s.destination_airport_code
  JOIN dim_date dd ON dd.full_date = s.flight_date
)
"""


@register("live_append_latest", _APPEND_SQL + """
SELECT p.flight_performance_id, a.airline_code, a.airline_name, p.flight_number,
  p.origin_airport_code AS origin_airport, p.destination_airport_code AS destination_airport,
  p.delay_minutes, CASE WHEN p.delay_minutes > 15 THEN 'Delayed' ELSE 'On Time' END AS delay_status,
  'Aviationstack' AS api_source, p.live_flight_status AS api_live_flight_status,
  p.departure_delay_minutes_live AS api_departure_delay_minutes,
  p.arrival_delay_minutes_live AS api_arrival_delay_minutes,
  CAST(NULL AS INTEGER) AS api_origin_live_departures_count,
  CAST(NULL AS INTEGER) AS api_destination_live_arrivals_count
FROM appended p JOIN airline_after a ON a.airline_id = p.airline_id
ORDER BY p.flight_performance_id DESC LIMIT 10""")
def q_live_append_latest(spark, sf_dir):
    from .operators.star import live_rows_report
    tables, _, _ = _appended(spark, sf_dir)
    return live_rows_report(tables)


@register("live_airline_refresh", _APPEND_SQL + "SELECT * FROM airline_after")
def q_live_airline_refresh(spark, sf_dir):
    tables, _, _ = _appended(spark, sf_dir)
    return tables["dim_airline"]


@register("live_append_counts", _APPEND_SQL + """
SELECT 'inserted' AS status, CAST(count(*) AS BIGINT) AS rows FROM appended
UNION ALL SELECT 'updated', CAST(0 AS BIGINT)
UNION ALL SELECT 'skipped', CAST((SELECT count(*) FROM live_tagged) - (SELECT count(*) FROM appended) AS BIGINT)""")
def q_live_append_counts(spark, sf_dir):
    return _appended(spark, sf_dir)[2]


@register("live_table_counts", _APPEND_SQL + """
SELECT 'fact_flightperformance' AS table_name, (SELECT count(*) FROM fact) + (SELECT count(*) FROM appended) AS row_count
UNION ALL SELECT 'dim_airline', count(*) FROM airline_after
UNION ALL SELECT 'dim_airport', count(*) FROM dim_airport
UNION ALL SELECT 'dim_date', count(*) FROM dim_date
UNION ALL SELECT 'live_fact_rows', (SELECT count(*) FROM appended)""")
def q_live_table_counts(spark, sf_dir):
    """The table counts after a live append: live rows are counted by their source."""
    return A.table_counts(_appended(spark, sf_dir)[0])


@register("smart_keys", _LIVE_SQL + """
SELECT page, pos, CAST(year(scheduled_departure_datetime) * 10000 + month(scheduled_departure_datetime) * 100
  + day(scheduled_departure_datetime) AS INTEGER) AS date_key,
  CAST(hour(scheduled_departure_datetime) * 100 + minute(scheduled_departure_datetime) AS INTEGER) AS time_key
FROM live_acc""")
def q_smart_keys(spark, sf_dir):
    from .functions.calendar import smart_date_key, smart_time_key
    from .plans.live_update import parse_batch
    acc = parse_batch(_live_pages(spark, sf_dir)).accepted
    return acc.select("page", "pos", smart_date_key("scheduled_departure_datetime").alias("date_key"),
                      smart_time_key("scheduled_departure_datetime").alias("time_key"))


# ---------------------------------------------------------------- weather enrichment

_W_METRICS = ["temperature_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall", "weather_code",
              "wind_speed_10m", "wind_gusts_10m"]


def _hourly(spark, sf_dir):
    from .sources import testbed
    from .sources.weather_json import hourly_rows, parse_payload_text
    return hourly_rows(parse_payload_text(testbed.weather_payloads(spark, sf_dir)))


@register("weather_explode", O.with_ctes(O.WEATHER) + """
SELECT airport_code, date, reading_hour, strftime(date, '%Y-%m-%d') || 'T' || lpad(CAST(reading_hour AS VARCHAR), 2, '0')
  || ':00' AS time, """ + ", ".join(_W_METRICS) + " FROM readings")
def q_weather_explode(spark, sf_dir):
    return _hourly(spark, sf_dir).select("airport_code", "date", "reading_hour", "time", *_W_METRICS)


@register("weather_nearest_hour", O.with_ctes(O.WEATHER) + """
SELECT r.request_id, r.airport_code, r.date, r.scheduled_hour, n.reading_hour AS matched_hour, """
          + ", ".join(f"coalesce(n.{m}, 0.0) AS {m}" for m in _W_METRICS) + """
FROM requests r LEFT JOIN nearest n ON n.request_id = r.request_id""")
def q_weather_nearest(spark, sf_dir):
    from .operators.weather import nearest_hour_weather
    from .sources import testbed
    return nearest_hour_weather(testbed.weather_requests(spark, sf_dir), _hourly(spark, sf_dir))


# ---------------------------------------------------------------- features & model statistics

_FEAT_SQL = O.with_ctes(O.FLIGHTS, O.STG, O.DIMS, O.RESOLVED, O.FACT, O.FEATURES)


def _prepared(spark, sf_dir):
    from .operators.features import prepare_features, training_dataset
    return prepare_features(training_dataset(warehouse_for(spark, sf_dir)))


def _feature_names():
    from .operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    return NUMERIC_FEATURES, CATEGORICAL_FEATURES


@register("training_features", _FEAT_SQL + O.prepared_select(*_feature_names()))
def q_training_features(spark, sf_dir):
    return _prepared(spark, sf_dir)


@register("delay_rates", _FEAT_SQL + """
SELECT 'airline_delay_rate' AS feature, airline_code AS key1, CAST(NULL AS VARCHAR) AS key2, airline_delay_rate AS rate FROM r_airline
UNION ALL SELECT 'origin_delay_rate', origin_airport_code, NULL, origin_delay_rate FROM r_origin
UNION ALL SELECT 'destination_delay_rate', destination_airport_code, NULL, destination_delay_rate FROM r_dest
UNION ALL SELECT 'route_delay_rate', origin_airport_code, destination_airport_code, route_delay_rate FROM r_route
UNION ALL SELECT 'aircraft_delay_rate', aircraft_category, NULL, aircraft_delay_rate FROM r_aircraft
UNION ALL SELECT 'weather_delay_rate', weather_type, NULL, weather_delay_rate FROM r_weather""")
def q_delay_rates(spark, sf_dir):
    from .operators.features import DELAY_RATE_GROUPS, add_flags, delay_rates
    from .operators.star import star_join
    flagged = add_flags(star_join(warehouse_for(spark, sf_dir)))
    out = None
    for name, table in delay_rates(flagged).items():
        keys = DELAY_RATE_GROUPS[name]
        part = table.select(F.lit(name).alias("feature"), F.col(keys[0]).cast("string").alias("key1"),
                            (F.col(keys[1]).cast("string") if len(keys) > 1 else F.lit(None).cast("string")).alias("key2"),
                            F.col(name).alias("rate"))
        out = part if out is None else out.unionByName(part)
    return out


_SPLIT_SQL = "(CAST(('0x' || substr(md5(CAST(flight_performance_id AS VARCHAR) || '42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2)"


@register("stratified_split", _FEAT_SQL + f"""
SELECT target_delayed, CASE WHEN {_SPLIT_SQL} THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS row_count
FROM feat GROUP BY 1, 2""")
def q_split(spark, sf_dir):
    from .ml.training import split_column
    df = _prepared(spark, sf_dir)
    return df.groupBy("target_delayed", split_column("flight_performance_id").alias("split")) \
        .agg(F.count(F.lit(1)).alias("row_count"))


@register("stratified_split_exact", _FEAT_SQL + """
, draws AS (SELECT flight_performance_id, target_delayed,
    CAST(('0x' || substr(md5(CAST(flight_performance_id AS VARCHAR) || '42'), 1, 8)) AS BIGINT) AS draw FROM feat),
classes AS (SELECT target_delayed, CAST(count(*) AS HUGEINT) AS n FROM draws GROUP BY 1),
shares AS (SELECT target_delayed, n, sum(n) OVER () AS total, sum(n) OVER () - CAST(ceil(sum(n) OVER () * 0.2) AS HUGEINT) AS train FROM classes),
parts AS (SELECT target_delayed, n, train, n * train // total AS whole, n * train % total AS rest FROM shares),
takes AS (SELECT target_delayed, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, target_delayed) <= train - sum(whole) OVER ()
    THEN 1 ELSE 0 END AS take FROM parts)
SELECT flight_performance_id, target_delayed,
  CASE WHEN row_number() OVER (PARTITION BY target_delayed ORDER BY draw, flight_performance_id) <= take THEN 'test' ELSE 'train' END AS split
FROM draws JOIN takes USING (target_delayed)""")
def q_split_exact(spark, sf_dir):
    """Every row's split: each class gives exactly its share."""
    from .ml.training import stratified_split
    return stratified_split(_prepared(spark, sf_dir), "flight_performance_id").select("flight_performance_id", "target_delayed", "split")


@register("class_weights", _FEAT_SQL + """
SELECT target_delayed, CAST(count(*) AS BIGINT) AS class_count,
  (SELECT count(*) FROM feat) / (2.0 * count(*)) AS class_weight
FROM feat GROUP BY target_delayed""")
def q_class_weights(spark, sf_dir):
    from .ml.training import class_weights
    return class_weights(_prepared(spark, sf_dir), "target_delayed")


@register("scaler_stats", _FEAT_SQL + " SELECT " + ", ".join(
    f"round(avg(coalesce(TRY_CAST({c} AS DOUBLE), 0.0)), 6) AS {c}_mean, "
    f"round(coalesce(stddev_samp(coalesce(TRY_CAST({c} AS DOUBLE), 0.0)), 0.0), 6) AS {c}_std"
    for c in _feature_names()[0]) + " FROM feat")
def q_scaler_stats(spark, sf_dir):
    from .ml.training import scaler_statistics
    return scaler_statistics(_prepared(spark, sf_dir), _feature_names()[0])


@register("classification_report", _FEAT_SQL + f"""
, scored AS (
  SELECT target_delayed AS label, CAST(coalesce(route_delay_rate, 0.0) > 0.5 AS INTEGER) AS prediction
  FROM feat WHERE {_SPLIT_SQL}
), cm AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2)
, t AS (SELECT
    coalesce(sum(n) FILTER (WHERE label = 1 AND prediction = 1), 0) AS tp,
    coalesce(sum(n) FILTER (WHERE label = 0 AND prediction = 1), 0) AS fp,
    coalesce(sum(n) FILTER (WHERE label = 1 AND prediction = 0), 0) AS fn,
    coalesce(sum(n) FILTER (WHERE label = 0 AND prediction = 0), 0) AS tn FROM cm)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END, 6) AS accuracy,
  round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(f1, 6) AS f1_1,
  round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(f0, 6) AS f1_0,
  CAST(tp + fn AS BIGINT) AS support_1, CAST(tn + fp AS BIGINT) AS support_0,
  round((p0 + p1) / 2, 6) AS macro_precision,
  round(CASE WHEN tp + fn + tn + fp > 0 THEN (p0 * (tn + fp) + p1 * (tp + fn)) / (tp + fn + tn + fp) ELSE 0.0 END, 6) AS weighted_precision,
  round((r0 + r1) / 2, 6) AS macro_recall,
  round(CASE WHEN tp + fn + tn + fp > 0 THEN (r0 * (tn + fp) + r1 * (tp + fn)) / (tp + fn + tn + fp) ELSE 0.0 END, 6) AS weighted_recall,
  round((f0 + f1) / 2, 6) AS macro_f1,
  round(CASE WHEN tp + fn + tn + fp > 0 THEN (f0 * (tn + fp) + f1 * (tp + fn)) / (tp + fn + tn + fp) ELSE 0.0 END, 6) AS weighted_f1
FROM (SELECT *,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
  CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0.0 END AS f0
  FROM t) m""")
def q_classification_report(spark, sf_dir):
    from .ml.training import binary_report, split_column
    df = _prepared(spark, sf_dir)
    test = df.where(split_column("flight_performance_id") == "test")
    scored = test.select(F.col("target_delayed").alias("label"),
                         (F.coalesce(F.col("route_delay_rate"), F.lit(0.0)) > 0.5).cast("int").alias("prediction"))
    return binary_report(scored)


# ---------------------------------------------------------------- data quality, previews, caps

def _dq_sql():
    parts = []
    for table, (id_col, key) in NATURAL_KEYS.items():
        parts.append(f"SELECT '{table}' AS table_name, 'duplicate {key}' AS check_name, CAST(count(*) AS BIGINT) AS violations "
                     f"FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1)")
        parts.append(f"SELECT '{table}', 'null {key}', CAST(count(*) AS BIGINT) FROM {table} WHERE {key} IS NULL")
        parts.append(f"SELECT '{table}', 'duplicate {id_col}', CAST(count(*) AS BIGINT) "
                     f"FROM (SELECT {id_col} FROM {table} GROUP BY {id_col} HAVING count(*) > 1)")
    parts.append("SELECT 'fact_flightperformance', 'duplicate natural key', CAST(count(*) AS BIGINT) FROM ("
                 "SELECT 1 FROM fact GROUP BY flight_id, date_id, scheduled_departure_time_id, origin_airport_id, "
                 "destination_airport_id HAVING count(*) > 1)")
    from .schemas import FACT_REFERENCES
    for fk, table in FACT_REFERENCES.items():
        id_col = NATURAL_KEYS[table][0]
        parts.append(f"SELECT 'fact_flightperformance', 'orphan {fk}', CAST(count(*) AS BIGINT) FROM fact "
                     f"WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {id_col} FROM {table})")
    return O.WAREHOUSE + "\nUNION ALL ".join(parts)


@register("dq_constraints", _dq_sql())
def q_dq(spark, sf_dir):
    from .operators.quality import constraint_report
    return constraint_report(warehouse_for(spark, sf_dir))


def _dq_change_sql() -> str:
    """The fact checks before and after the live upsert, and those of the dimension it grows, subtracted."""
    from .schemas import FACT_KEY, FACT_REFERENCES
    keys = ", ".join(FACT_KEY)
    fks = [f for f in FACT_REFERENCES if f not in FACT_KEY]

    def checks(sign: str, fact: str, time: str) -> list[str]:
        tables = {t: t for t in NATURAL_KEYS} | {"dim_time": time}
        out = [f"SELECT 'fact_flightperformance' AS table_name, 'duplicate natural key' AS check_name, {sign}count(*) AS v "
               f"FROM (SELECT 1 FROM {fact} GROUP BY {keys} HAVING count(*) > 1)"]
        for fk, table in FACT_REFERENCES.items():
            out.append(f"SELECT 'fact_flightperformance', 'orphan {fk}', {sign}count(*) FROM {fact} WHERE {fk} IS NOT NULL "
                       f"AND {fk} NOT IN (SELECT {NATURAL_KEYS[table][0]} FROM {tables[table]})")
        for column in ("time_value", "time_id"):
            out.append(f"SELECT 'dim_time', 'duplicate {column}', {sign}count(*) FROM (SELECT 1 FROM {time} WHERE {column} IS NOT NULL "
                       f"GROUP BY {column} HAVING count(*) > 1)")
        return [*out, f"SELECT 'dim_time', 'null time_value', {sign}count(*) FROM {time} WHERE time_value IS NULL"]

    parts = checks("", "fact_after", "live_dim_time") + checks("-", "fact", "dim_time")
    return (_LIVE_UPSERT_SQL + f", fact_after AS (SELECT {keys}, {', '.join(fks)} FROM live_merged UNION ALL "
            f"SELECT {keys}, {', '.join(fks)} FROM fact ANTI JOIN live_merged USING ({keys}))\n"
            "SELECT table_name, check_name, CAST(sum(v) AS BIGINT) AS change FROM (" + "\nUNION ALL ".join(parts) + ") GROUP BY ALL")


@register("dq_batch_change", _dq_change_sql())
def q_dq_batch(spark, sf_dir):
    """What the live upsert adds to the constraint report, from the merge and the rows it replaces alone."""
    from .operators.quality import batch_constraint_change
    r = _upserted(spark, sf_dir)
    return batch_constraint_change(warehouse_for(spark, sf_dir), r.tables, r.merge, r.changed_dims)


@register("table_preview", O.WAREHOUSE + "SELECT * FROM dim_date ORDER BY date_id LIMIT 100")
def q_table_preview(spark, sf_dir):
    from .sources.files import table_preview
    # the preview's fixed page size (100 rows, reference rule) is the feature
    return table_preview(warehouse_for(spark, sf_dir), "dim_date", "date_id")


@register("row_cap", O.with_ctes(O.FLIGHTS) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, flight_number FROM flights
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 100000""")
def q_row_cap(spark, sf_dir):
    from .sources import testbed
    from .sources.files import cap_rows
    # the optional "first n rows in file order" switch of the historical load is the feature (its size: the reference's)
    f = testbed.flights_raw(spark, sf_dir)
    return cap_rows(f, 100_000, testbed.FLIGHT_ORDINAL).select(*testbed.FLIGHT_ORDINAL, "flight_number")


@register("live_airport_aggregates", _APPEND_SQL + """
, dep AS (SELECT origin_airport_code AS airport_code, CAST(count(*) AS BIGINT) AS live_departures_count,
            CAST(sum(CAST(departure_delay_minutes_live > 15 AS INTEGER)) AS BIGINT) AS delayed_departures_count,
            avg(departure_delay_minutes_live) AS avg_departure_delay FROM appended GROUP BY 1),
  arr AS (SELECT destination_airport_code AS airport_code, CAST(count(*) AS BIGINT) AS live_arrivals_count,
            CAST(sum(CAST(arrival_delay_minutes_live > 15 AS INTEGER)) AS BIGINT) AS delayed_arrivals_count,
            avg(arrival_delay_minutes_live) AS avg_arrival_delay FROM appended GROUP BY 1)
SELECT airport_code, live_departures_count, live_arrivals_count, delayed_departures_count, delayed_arrivals_count,
  avg_departure_delay, avg_arrival_delay
FROM dep FULL OUTER JOIN arr USING (airport_code)""")
def q_live_airport_aggregates(spark, sf_dir):
    from .operators.features import LIVE_AIRPORT_COLUMNS, live_airport_aggregates
    tables, appended, _ = _appended(spark, sf_dir)
    agg = live_airport_aggregates(appended)
    codes = tables["dim_airport"].select("airport_id", "airport_code")
    out = agg.join(broadcast_if_small(codes), "airport_id").select("airport_code", *LIVE_AIRPORT_COLUMNS)
    return out.withColumns({c: F.col(c).cast("bigint") for c in LIVE_AIRPORT_COLUMNS if c.endswith("count")})


@register("live_running_aggregates", _LIVE_SQL + """
, dep AS (SELECT origin_airport_code AS airport_code, count(*) AS live_departures_count,
            CAST(sum(CAST(departure_delay_minutes_live > 15 AS INTEGER)) AS BIGINT) AS delayed_departures_count,
            avg(departure_delay_minutes_live) AS avg_departure_delay FROM live_acc GROUP BY 1),
  arr AS (SELECT destination_airport_code AS airport_code, count(*) AS live_arrivals_count,
            CAST(sum(CAST(arrival_delay_minutes_live > 15 AS INTEGER)) AS BIGINT) AS delayed_arrivals_count,
            avg(arrival_delay_minutes_live) AS avg_arrival_delay FROM live_acc GROUP BY 1)
SELECT airport_code, live_departures_count, live_arrivals_count, delayed_departures_count, delayed_arrivals_count,
  avg_departure_delay, avg_arrival_delay
FROM dep FULL OUTER JOIN arr USING (airport_code)""")
def q_live_running_aggregates(spark, sf_dir):
    """The live pages, landed in files that several micro-batches pick up, added to keyed streaming state."""
    from .streaming.running_aggregates import read_running_aggregates, run_running_aggregates
    base = scratch_path(spark, f"running-{uuid.uuid4().hex}")
    _live_pages(spark, sf_dir).repartition(9).write.parquet(f"{base}/landing")
    pages = spark.readStream.schema("page bigint, payload string").option("maxFilesPerTrigger", 3).parquet(f"{base}/landing")
    run_running_aggregates(pages, f"{base}/out", f"{base}/state")
    return read_running_aggregates(spark, f"{base}/out")


@register("serve_features", O.STARRED + """
, req AS (SELECT flight_number, max(full_date) + INTERVAL 7 DAY AS selected_date FROM star GROUP BY flight_number),
  pick AS (
    SELECT * FROM (
      SELECT q.flight_number AS request_fn, CAST(q.selected_date AS DATE) AS selected_date, s.*,
        row_number() OVER (PARTITION BY q.flight_number ORDER BY s.full_date DESC, s.flight_performance_id DESC) AS rn
      FROM req q JOIN star s ON upper(trim(s.flight_number)) = upper(trim(q.flight_number)))
    WHERE rn = 1)
SELECT request_fn AS flight_number, selected_date, flight_performance_id,
  CAST(day(selected_date) AS INTEGER) AS day, CAST(month(selected_date) AS INTEGER) AS month,
  CAST(year(selected_date) AS INTEGER) AS year, CAST(quarter(selected_date) AS INTEGER) AS quarter,
  CAST(isodow(selected_date) - 1 AS INTEGER) AS day_of_week, isodow(selected_date) IN (6, 7) AS is_weekend,
  hour, airline_code, origin_airport_code, destination_airport_code
FROM pick""")
def q_serve_features(spark, sf_dir):
    from .ml.scoring import history_for_requests, override_date
    star = star_lookup(warehouse_for(spark, sf_dir))
    req = star.groupBy("flight_number").agg(F.date_add(F.max("full_date"), 7).alias("selected_date")) \
        .withColumn("request_id", F.col("flight_number"))
    rows = override_date(history_for_requests(req, star))
    return rows.select(F.col("request_id").alias("flight_number"), "selected_date", "flight_performance_id", "day",
                       "month", "year", "quarter", "day_of_week", "is_weekend", "hour", "airline_code",
                       "origin_airport_code", "destination_airport_code")


def _requests(star):
    """One request per flight number, half a year after its last flight (another season)."""
    return star.groupBy("flight_number").agg(F.date_add(F.max("full_date"), 180).alias("selected_date")) \
        .withColumn("request_id", F.col("flight_number"))


def _serving(spark, sf_dir):
    from .ml.scoring import model_inputs
    from .operators.features import add_flags, live_airport_aggregates
    from .operators.star import star_join
    wh = warehouse_for(spark, sf_dir)
    star = star_join(wh)
    fact = wh["fact_flightperformance"]
    live = stored(live_airport_aggregates(fact.where(F.col("api_source") == A.LIVE_SOURCE)), "live")
    requests = stored(_requests(star), "requests")
    return requests, model_inputs(requests, star, add_flags(star), live)


@register("serve_model_input", _FEAT_SQL + "," + O.SERVED + O.served_select(*_feature_names()))
def q_serve_model_input(spark, sf_dir):
    """All 55 model columns of every request, after the date override."""
    numeric, categorical = _feature_names()
    return _serving(spark, sf_dir)[1].select("flight_number", "flight_performance_id", *numeric, *categorical)


# ---------------------------------------------------------------- model training and scoring (rows-only)

def _trained(spark, sf_dir):
    """Board and best model at full sizes, trained once per application and data folder."""
    from .ml.training import train_and_select
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _TRAINED:
        _TRAINED[key] = train_and_select(stored(_prepared(spark, sf_dir), "prepared"))[1:]
    return _TRAINED[key]


_TRAINED: dict = {}


@register("train_leaderboard")
def q_train_leaderboard(spark, sf_dir):
    return _trained(spark, sf_dir)[1]


@register("batch_predict")
def q_batch_predict(spark, sf_dir):
    from .ml.scoring import predict
    requests, inputs = _serving(spark, sf_dir)
    return predict(_trained(spark, sf_dir)[0], requests, inputs)


_STORED_MODELS: dict = {}


def _stored_model(spark, sf_dir) -> str:
    """Where the application keeps a decision tree fitted on the whole train split of the data folder (fitted and saved once)."""
    from .ml import training as M

    def fit() -> str:
        path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
        data = M.stratified_split(M.with_class_weights(stored(_prepared(spark, sf_dir), "prepared")), "flight_performance_id")
        train = data.where("split = 'train'")
        prep = M.Pipeline(stages=M.preprocessing_stages()).fit(train)
        held = set(spark.sparkContext._jsc.getPersistentRDDs())
        tree = M.classifiers(1)["Decision Tree"].fit(prep.transform(train))
        M.release_since(spark, held)
        M.store_model(M.PipelineModel(stages=[*prep.stages, tree]), path, source_signature(spark, sf_dir))
        return path
    return _once(_STORED_MODELS, spark, sf_dir, fit)


@register("stored_model_predict")
def q_stored_model_predict(spark, sf_dir):
    """Every request scored with the model as it was saved; another feature list would be refused."""
    from .ml.training import load_stored_model
    numeric, categorical = _feature_names()
    inputs = _serving(spark, sf_dir)[1].select("request_id", "flight_number", "flight_performance_id", *numeric, *categorical)
    return load_stored_model(spark, _stored_model(spark, sf_dir)).score(inputs).drop("data_version")


# ---------------------------------------------------------------- lookups, leak-free rates, flags

_LIVE_WH_SQL = O.with_ctes(O.FLIGHTS, O.STG, O.DIMS, O.RESOLVED, O.FACT, O.LIVE_FLAT)


@register("dim_insert_if_absent", _LIVE_UPSERT_SQL + "SELECT * FROM live_dim_time")
def q_dim_insert_if_absent(spark, sf_dir):
    """The time dimension after a live batch: existing members unchanged, new clocks appended
    after the current max id in natural-key order."""
    return _upserted(spark, sf_dir).tables["dim_time"]


@register("route_lookup", _LIVE_WH_SQL + """
SELECT flight_number, flight_type, route_category, route_distance FROM dim_flight
WHERE flight_number IN (SELECT flight_number FROM live_acc)""")
def q_route_lookup(spark, sf_dir):
    """Route details for every flight number a live batch asks about: the per-key
    ``WHERE flight_number = ? LIMIT 1`` as one semi join + keep-first."""
    from .plans.live_update import parse_batch
    req = parse_batch(_live_pages(spark, sf_dir)).accepted.select("flight_number")
    hits = A.lookup_many(warehouse_for(spark, sf_dir)["dim_flight"], req, "flight_number", "flight_id")
    return hits.select("flight_number", "flight_type", "route_category", "route_distance")


@register("airport_lookup", _LIVE_WH_SQL + """
SELECT airport_id, airport_code, airport_name, city, country, latitude, longitude FROM dim_airport
WHERE airport_code IN (SELECT origin_airport_code FROM live_acc UNION SELECT destination_airport_code FROM live_acc)""")
def q_airport_lookup(spark, sf_dir):
    """Airport rows for both airport roles of a live batch (per-code lookup, set-based)."""
    from .plans.live_update import parse_batch
    acc = parse_batch(_live_pages(spark, sf_dir)).accepted
    req = acc.select(F.col("origin_airport_code").alias("airport_code")).unionByName(
        acc.select(F.col("destination_airport_code").alias("airport_code")))
    hits = A.lookup_many(warehouse_for(spark, sf_dir)["dim_airport"], req, "airport_code", "airport_id")
    return hits.select("airport_id", "airport_code", "airport_name", "city", "country", "latitude", "longitude")


def _leakfree_sql() -> str:
    ctes = [f", tr AS MATERIALIZED (SELECT * FROM flagged WHERE NOT {_SPLIT_SQL})",
            f"te AS MATERIALIZED (SELECT * FROM flagged WHERE {_SPLIT_SQL})",
            "m AS (SELECT coalesce(avg(CAST(target_delayed AS DOUBLE)), 0.0) AS mean_rate FROM tr)"]
    sel, joins = [], []
    for i, (name, keys) in enumerate(DELAY_RATE_GROUPS.items()):
        ks = ", ".join(keys)
        ctes.append(f"t{i} AS (SELECT {ks}, avg(CAST(target_delayed AS DOUBLE)) AS r FROM tr WHERE "
                    + " AND ".join(f"{k} IS NOT NULL" for k in keys) + f" GROUP BY {ks})")
        joins.append(f"LEFT JOIN t{i} ON " + " AND ".join(f"t{i}.{k} = te.{k}" for k in keys))
        sel.append(f"coalesce(t{i}.r, m.mean_rate) AS {name}")
    return (_FEAT_SQL + ",\n".join(ctes) + "\nSELECT te.flight_performance_id, " + ", ".join(sel)
            + " FROM te CROSS JOIN m " + " ".join(joins))


@register("delay_rates_leakfree", _leakfree_sql())
def q_delay_rates_leakfree(spark, sf_dir):
    """Delay rates fitted on the training split only, applied to the test split; keys unseen in
    training take the training mean."""
    from .ml.training import split_column
    from .operators.features import add_flags, attach_delay_rates
    from .operators.star import star_join
    flagged = add_flags(star_join(warehouse_for(spark, sf_dir))) \
        .withColumn("_split", split_column("flight_performance_id"))
    train, test = flagged.where(F.col("_split") == "train"), flagged.where(F.col("_split") == "test")
    return attach_delay_rates(test, fit=train, fallback_to_mean=True) \
        .select("flight_performance_id", *DELAY_RATE_GROUPS)


def _out_of_fold_sql() -> str:
    columns = []
    for name, keys in DELAY_RATE_GROUPS.items():
        ks = ", ".join(keys)
        rest = " - ".join(f"{{0}} OVER (PARTITION BY {by})" for by in (ks, f"{ks}, fold"))
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        columns.append(f"coalesce(CASE WHEN {known} THEN ({rest.format('sum(target_delayed)')}) / nullif({rest.format('count(*)')}, 0) END, "
                       f"mean_rate, 0.0) AS {name}")
    return (_FEAT_SQL + """, folded AS (
  SELECT *, CAST(('0x' || substr(md5(CAST(flight_performance_id AS VARCHAR) || 'fold'), 1, 8)) AS BIGINT) % 5 AS fold FROM flagged),
means AS (SELECT *, (sum(target_delayed) OVER () - sum(target_delayed) OVER (PARTITION BY fold))
    / nullif(count(*) OVER () - count(*) OVER (PARTITION BY fold), 0) AS mean_rate FROM folded)
SELECT flight_performance_id, CAST(fold AS INTEGER) AS fold, """ + ", ".join(columns) + " FROM means")


@register("delay_rates_out_of_fold", _out_of_fold_sql())
def q_delay_rates_out_of_fold(spark, sf_dir):
    """Delay rates of every row from the rows of the other folds: no row's label feeds its own rate."""
    from .operators.features import add_flags, attach_out_of_fold_rates, fold_column
    from .operators.star import star_join
    flagged = add_flags(star_join(warehouse_for(spark, sf_dir))).withColumn("fold", fold_column("flight_performance_id"))
    return attach_out_of_fold_rates(flagged, "fold").select("flight_performance_id", "fold", *DELAY_RATE_GROUPS)


_FLAG_COLS = ["day_of_week", "is_weekend", "is_night_flight", "is_morning", "is_afternoon", "is_evening",
              "is_peak_hour", "is_winter", "is_summer", "is_holiday_season", "low_visibility", "high_wind",
              "bad_weather", "short_route", "medium_route", "long_route", "target_delayed"]


@register("feature_flags", _FEAT_SQL + "SELECT flight_performance_id, hour, month, " + ", ".join(_FLAG_COLS)
          + " FROM flagged")
def q_feature_flags(spark, sf_dir):
    """Calendar, clock, season, weather and route flags and the target for every fact row."""
    from .operators.features import add_flags
    from .operators.star import star_join
    return add_flags(star_join(warehouse_for(spark, sf_dir))).select("flight_performance_id", "hour", "month",
                                                                     *_FLAG_COLS)
