"""DuckDB SQL mirrors of the test-bed warehouse, for the driver's oracle comparison.

Each query in the catalog is ``WITH <the CTEs it needs> SELECT ...`` over the driver's
pre-registered views (lineitem, orders, part, ...).  The CTEs restate the same rules as the
Spark code in plain SQL: flight view, staging, dimensions (ids in natural-key order, seeded
members in list order), key resolution, and the upsert's keep-first / keep-last per key.
"""

from __future__ import annotations

from .schemas import FACT_REFERENCES, NATURAL_KEYS


def clock_sql(v: str) -> str:
    """HHMM -> 'HH:MM:00' (hour >= 24 -> 23:59; impossible readings -> NULL)."""
    return (f"CASE WHEN {v} IS NULL OR {v} < 0 OR {v} > 9999 THEN NULL "
            f"WHEN {v} // 100 >= 24 THEN '23:59:00' "
            f"WHEN {v} % 100 >= 60 THEN NULL "
            f"ELSE lpad(CAST({v} // 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST({v} % 100 AS VARCHAR), 2, '0') || ':00' END")


def part_of_day_sql(h: str) -> str:
    return (f"CASE WHEN {h} IS NULL THEN 'Unknown' WHEN {h} >= 5 AND {h} < 12 THEN 'Morning' "
            f"WHEN {h} >= 12 AND {h} < 17 THEN 'Afternoon' WHEN {h} >= 17 AND {h} < 21 THEN 'Evening' "
            f"ELSE 'Night' END")


FLIGHTS = """
flights AS (
  SELECT
    CAST(year(o.o_orderdate) AS INTEGER) AS year,
    CAST(month(o.o_orderdate) AS INTEGER) AS month,
    CAST(day(o.o_orderdate) AS INTEGER) AS day,
    upper(substr(p.p_type, 1, 2)) AS airline,
    CASE WHEN p.p_size % 7 = 0 THEN CAST(l.l_suppkey AS VARCHAR)
         ELSE upper(substr(p.p_type, 1, 2)) || CAST(l.l_suppkey AS VARCHAR) END AS flight_number,
    sn.n_name AS origin_airport,
    cn.n_name AS destination_airport,
    CASE WHEN l.l_partkey % 101 = 0 THEN NULL
         WHEN l.l_partkey % 97 = 0 THEN CAST(2400 AS BIGINT)
         ELSE (l.l_partkey % 24) * 100 + l.l_suppkey % 60 END AS scheduled_departure,
    CASE WHEN l.l_linenumber = 7 THEN NULL
         ELSE (l.l_partkey % 24) * 100 + (l.l_suppkey + CAST(trunc(l.l_quantity) AS BIGINT)) % 60 END AS departure_time,
    CASE WHEN l.l_linenumber = 7 THEN NULL
         ELSE CAST(datediff('day', o.o_orderdate, l.l_shipdate) AS DOUBLE) + l.l_discount * 10 END AS departure_delay,
    l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate,
    l.l_returnflag, l.l_linestatus, l.l_tax, l.l_discount, p.p_type, o.o_orderdate
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
)"""

STG = f"""
stg AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    flight_number,
    coalesce(airline, 'Unknown') AS airline_code,
    coalesce(origin_airport, 'Unknown') AS origin_airport_code,
    coalesce(destination_airport, 'Unknown') AS destination_airport_code,
    TRY_CAST(printf('%04d-%02d-%02d', year, month, day) AS DATE) AS flight_date,
    {clock_sql('scheduled_departure')} AS scheduled_departure_time,
    {clock_sql('departure_time')} AS actual_departure_time,
    CAST(trunc(coalesce(departure_delay, 0)) AS INTEGER) AS delay_minutes,
    coalesce(departure_delay, 0) > 15 AS is_delayed,
    'Unknown' AS aircraft_type, 'Unknown' AS weather_condition, 'None' AS delay_cause
  FROM flights
)"""

DIMS = f"""
airlines_raw AS (
  SELECT upper(substr(p_type, 1, 2)) AS iata_code, p_type AS airline, p_partkey FROM part
),
airports_raw AS (
  SELECT n.n_name AS iata_code, n.n_name || ' Intl' AS airport,
    upper(substr(n.n_name, 1, 1)) || lower(substr(n.n_name, 2)) AS city,
    r.r_name AS country, n.n_nationkey * 1.5 AS latitude, n.n_regionkey * -10.0 AS longitude, n.n_nationkey
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
dim_airline AS (
  SELECT CAST(row_number() OVER (ORDER BY airline_code) AS INTEGER) AS airline_id, airline_code, airline_name
  FROM (SELECT iata_code AS airline_code, airline AS airline_name,
               row_number() OVER (PARTITION BY iata_code ORDER BY p_partkey) AS rn
        FROM airlines_raw WHERE iata_code IS NOT NULL) WHERE rn = 1
),
dim_airport AS (
  SELECT CAST(row_number() OVER (ORDER BY airport_code) AS INTEGER) AS airport_id, airport_code, airport_name,
    city, CAST(NULL AS VARCHAR) AS state, country, latitude, longitude,
    CAST(NULL AS VARCHAR) AS continent, CAST(NULL AS VARCHAR) AS airport_type, CAST(NULL AS DOUBLE) AS elevation
  FROM (SELECT iata_code AS airport_code, airport AS airport_name, city, country, latitude, longitude,
               row_number() OVER (PARTITION BY iata_code ORDER BY n_nationkey) AS rn
        FROM airports_raw WHERE iata_code IS NOT NULL) WHERE rn = 1
),
dim_date AS (
  SELECT CAST(row_number() OVER (ORDER BY full_date) AS INTEGER) AS date_id, full_date,
    CAST(year(full_date) AS INTEGER) AS year, CAST(month(full_date) AS INTEGER) AS month,
    CAST(day(full_date) AS INTEGER) AS day, CAST(quarter(full_date) AS INTEGER) AS quarter,
    CAST(isodow(full_date) - 1 AS INTEGER) AS day_of_week, isodow(full_date) IN (6, 7) AS is_weekend
  FROM (SELECT DISTINCT flight_date AS full_date FROM stg WHERE flight_date IS NOT NULL)
),
dim_time AS (
  SELECT CAST(row_number() OVER (ORDER BY time_value) AS INTEGER) AS time_id, time_value,
    CAST(substr(time_value, 1, 2) AS INTEGER) AS hour, CAST(substr(time_value, 4, 2) AS INTEGER) AS minute,
    {part_of_day_sql('CAST(substr(time_value, 1, 2) AS INTEGER)')} AS time_of_day
  FROM (SELECT DISTINCT t AS time_value FROM (
          SELECT scheduled_departure_time AS t FROM stg UNION ALL SELECT actual_departure_time FROM stg)
        WHERE t IS NOT NULL)
),
dim_flight AS (
  SELECT CAST(row_number() OVER (ORDER BY flight_number) AS INTEGER) AS flight_id, flight_number,
    CAST(NULL AS VARCHAR) AS flight_type, CAST(NULL AS VARCHAR) AS route_category, CAST(NULL AS DOUBLE) AS route_distance
  FROM (SELECT DISTINCT flight_number FROM stg WHERE flight_number IS NOT NULL)
),
dim_aircraft AS (
  SELECT CAST(1 AS INTEGER) AS aircraft_id, 'Unknown' AS aircraft_type, CAST(NULL AS VARCHAR) AS tail_number,
    CAST(NULL AS VARCHAR) AS aircraft_model, CAST(NULL AS VARCHAR) AS manufacturer,
    CAST(NULL AS INTEGER) AS seating_capacity, CAST(NULL AS VARCHAR) AS aircraft_category
),
dim_weather_condition AS (
  SELECT CAST(1 AS INTEGER) AS weather_condition_id, 'Unknown' AS weather_condition,
    CAST(NULL AS DOUBLE) AS temperature, CAST(NULL AS DOUBLE) AS wind_speed, CAST(NULL AS DOUBLE) AS visibility
),
dim_delay_cause AS (
  SELECT CAST(delay_cause_id AS INTEGER) AS delay_cause_id, delay_cause,
    CAST(NULL AS VARCHAR) AS delay_cause_detail, CAST(NULL AS BOOLEAN) AS is_controllable
  FROM (VALUES (1, 'None'), (2, 'Carrier'), (3, 'Weather'), (4, 'NAS'), (5, 'Security'), (6, 'Late Aircraft'))
       AS t(delay_cause_id, delay_cause)
)"""

RESOLVED = """
resolved AS (
  SELECT s.*, f.flight_id, a.airline_id, o.airport_id AS origin_airport_id, d.airport_id AS destination_airport_id,
    dd.date_id, st.time_id AS scheduled_departure_time_id, act.time_id AS actual_departure_time_id,
    ac.aircraft_id, w.weather_condition_id, dc.delay_cause_id,
    CAST(year(s.flight_date) * 100 + month(s.flight_date) AS INTEGER) AS flight_month
  FROM stg s
  JOIN dim_flight f ON f.flight_number = s.flight_number
  JOIN dim_airline a ON a.airline_code = s.airline_code
  JOIN dim_airport o ON o.airport_code = s.origin_airport_code
  JOIN dim_airport d ON d.airport_code = s.destination_airport_code
  JOIN dim_date dd ON dd.full_date = s.flight_date
  JOIN dim_time st ON st.time_value = s.scheduled_departure_time
  LEFT JOIN dim_time act ON act.time_value = s.actual_departure_time
  JOIN dim_aircraft ac ON ac.aircraft_type = s.aircraft_type
  JOIN dim_weather_condition w ON w.weather_condition = s.weather_condition
  JOIN dim_delay_cause dc ON dc.delay_cause = s.delay_cause
),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS seq
  FROM resolved
)"""

FACT = """
fact AS (
  SELECT CAST(row_number() OVER (ORDER BY min(seq)) AS BIGINT) AS flight_performance_id,
    flight_id, date_id, scheduled_departure_time_id, origin_airport_id, destination_airport_id,
    arg_min(airline_id, seq) AS airline_id, arg_min(aircraft_id, seq) AS aircraft_id,
    arg_min(flight_month, seq) AS flight_month,
    arg_max_null(actual_departure_time_id, seq) AS actual_departure_time_id,
    arg_max_null(weather_condition_id, seq) AS weather_condition_id,
    arg_max_null(delay_cause_id, seq) AS delay_cause_id,
    arg_max_null(delay_minutes, seq) AS delay_minutes,
    arg_max_null(is_delayed, seq) AS is_delayed,
    TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at,
    CAST(NULL AS VARCHAR) AS api_source, CAST(NULL AS VARCHAR) AS delay_status
  FROM numbered
  GROUP BY flight_id, date_id, scheduled_departure_time_id, origin_airport_id, destination_airport_id
)"""

def _star_source(fact: str, columns: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """Select list and FROM text of a star: each fact reference that supplies a column is left-joined
    on its id.  ``columns``: by foreign key, ``name`` or ``name AS alias`` of its dimension."""
    picked, source = [], fact
    for k, (fk, names) in enumerate(columns.items()):
        table = FACT_REFERENCES[fk]
        source += f" LEFT JOIN {table} AS j{k} ON j{k}.{NATURAL_KEYS[table][0]} = base.{fk}"
        picked += [f"j{k}.{n}" for n in names]
    return ", ".join(picked), source


_STAR_COLUMNS, _STAR_FROM = _star_source("fact AS base", {
    "airline_id": ("airline_code", "airline_name"),
    "flight_id": ("flight_number", "flight_type", "route_category", "route_distance"),
    "date_id": ("full_date", "day", "month", "year", "day_of_week", "is_weekend"),
    "scheduled_departure_time_id": ("hour", "minute", "time_of_day"),
    "aircraft_id": ("aircraft_type", "aircraft_model", "manufacturer", "seating_capacity", "aircraft_category"),
    "weather_condition_id": ("weather_condition AS weather_type", "temperature", "wind_speed", "visibility"),
    "delay_cause_id": ("delay_cause AS delay_cause_type", "delay_cause_detail", "is_controllable"),
    "origin_airport_id": ("airport_code AS origin_airport_code", "airport_name AS origin_airport_name"),
    "destination_airport_id": ("airport_code AS destination_airport_code", "airport_name AS destination_airport_name"),
})
STAR = f"""
star AS (
  SELECT flight_performance_id, delay_minutes, is_delayed, created_at, updated_at, {_STAR_COLUMNS},
    CAST(coalesce(floor((month - 1) / 3) + 1, 1) AS INTEGER) AS quarter
  FROM {_STAR_FROM}
),
dash AS (
  SELECT *, delay_minutes AS departure_delay, hour AS departure_hour,
    origin_airport_code AS origin_airport, destination_airport_code AS destination_airport
  FROM star
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


WAREHOUSE = with_ctes(FLIGHTS, STG, DIMS, RESOLVED, FACT)
STARRED = with_ctes(FLIGHTS, STG, DIMS, RESOLVED, FACT, STAR)


# ---------------------------------------------------------------- live API batch

LIVE_FLAT = f"""
live_base AS (
  SELECT *, {clock_sql('scheduled_departure')} AS _sched, {clock_sql('departure_time')} AS _act,
    strftime(o_orderdate, '%Y-%m-%d') AS _day
  FROM flights
),
live_flat AS (
  SELECT l_orderkey AS page,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS INTEGER) AS pos,
    CASE WHEN l_partkey % 13 = 0 THEN '' ELSE flight_number END AS flight_number,
    airline AS airline_code,
    CASE WHEN l_linenumber = 1 THEN airline ELSE p_type END AS airline_name,
    origin_airport AS origin_airport_code,
    CASE WHEN l_linenumber = 2 THEN origin_airport ELSE origin_airport || ' Intl' END AS origin_airport_name,
    CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE destination_airport END AS destination_airport_code,
    destination_airport || ' Intl' AS destination_airport_name,
    CASE WHEN l_linestatus = 'F' THEN 'landed' ELSE 'active' END AS live_flight_status,
    CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(trunc(l_tax * 1000) AS INTEGER) - 20 END AS departure_delay_minutes_live,
    CASE WHEN l_linenumber = 4 THEN 0 ELSE CAST(trunc(l_discount * 1000) AS INTEGER) END AS arrival_delay_minutes_live,
    CASE WHEN _sched IS NULL THEN NULL
         WHEN l_linenumber = 5 AND l_partkey % 3 = 0 THEN 'bad-timestamp'
         ELSE _day || 'T' || CASE WHEN l_linenumber = 2 THEN substr(_sched, 1, 5) || ':30' ELSE _sched END
              || CASE WHEN l_linenumber % 2 = 0 THEN 'Z' ELSE '+02:00' END END AS scheduled_departure_datetime,
    CASE WHEN _act IS NULL THEN NULL ELSE _day || 'T' || _act || '+05:30' END AS actual_departure_datetime,
    _day || 'T23:00:00Z' AS scheduled_arrival_datetime,
    CAST(NULL AS VARCHAR) AS actual_arrival_datetime,
    'Unknown' AS flight_type, 'Unknown' AS route_category, CAST(NULL AS DOUBLE) AS route_distance,
    (l_partkey % 13 <> 0 AND l_partkey % 89 <> 0) AS _keep
  FROM live_base
),
live_tagged AS (
  SELECT *, TRY_CAST(substr(scheduled_departure_datetime, 1, 19) AS TIMESTAMP) AS _sts,
    CASE WHEN NOT _keep THEN 'missing flight, airline or airport code'
         WHEN scheduled_departure_datetime IS NULL OR trim(scheduled_departure_datetime) = '' THEN 'missing scheduled departure'
         WHEN TRY_CAST(substr(scheduled_departure_datetime, 1, 19) AS TIMESTAMP) IS NULL THEN 'malformed scheduled departure'
    END AS reason
  FROM live_flat
),
live_acc AS (
  SELECT page, pos, flight_number, airline_code, airline_name, origin_airport_code, origin_airport_name,
    destination_airport_code, destination_airport_name,
    CAST(_sts AS DATE) AS flight_date, strftime(_sts, '%H:%M:%S') AS scheduled_departure_time,
    strftime(TRY_CAST(substr(actual_departure_datetime, 1, 19) AS TIMESTAMP), '%H:%M:%S') AS actual_departure_time,
    departure_delay_minutes_live AS delay_minutes, departure_delay_minutes_live > 15 AS is_delayed,
    'Unknown' AS aircraft_type, 'Unknown' AS weather_condition, 'None' AS delay_cause,
    CAST(year(_sts) * 100 + month(_sts) AS INTEGER) AS flight_month,
    live_flight_status, departure_delay_minutes_live, arrival_delay_minutes_live,
    _sts AS scheduled_departure_datetime,
    TRY_CAST(substr(actual_departure_datetime, 1, 19) AS TIMESTAMP) AS actual_departure_datetime,
    TRY_CAST(substr(scheduled_arrival_datetime, 1, 19) AS TIMESTAMP) AS scheduled_arrival_datetime,
    CAST(NULL AS TIMESTAMP) AS actual_arrival_datetime
  FROM live_tagged WHERE reason IS NULL
)"""

# Time members the live batch adds (the only dimension the test-bed batch grows).
LIVE_DIMS = f"""
live_dim_time AS (
  SELECT * FROM dim_time
  UNION ALL
  SELECT CAST((SELECT max(time_id) FROM dim_time) + row_number() OVER (ORDER BY time_value) AS INTEGER),
    time_value, CAST(substr(time_value, 1, 2) AS INTEGER), CAST(substr(time_value, 4, 2) AS INTEGER),
    {part_of_day_sql('CAST(substr(time_value, 1, 2) AS INTEGER)')}
  FROM (SELECT DISTINCT t AS time_value FROM (
          SELECT scheduled_departure_time AS t FROM live_acc UNION ALL SELECT actual_departure_time FROM live_acc)
        WHERE t IS NOT NULL AND t NOT IN (SELECT time_value FROM dim_time))
),
live_resolved AS (
  SELECT s.*, f.flight_id, a.airline_id, o.airport_id AS origin_airport_id, d.airport_id AS destination_airport_id,
    dd.date_id, st.time_id AS scheduled_departure_time_id, act.time_id AS actual_departure_time_id,
    ac.aircraft_id, w.weather_condition_id, dc.delay_cause_id
  FROM live_acc s
  JOIN dim_flight f ON f.flight_number = s.flight_number
  JOIN dim_airline a ON a.airline_code = s.airline_code
  JOIN dim_airport o ON o.airport_code = s.origin_airport_code
  JOIN dim_airport d ON d.airport_code = s.destination_airport_code
  JOIN dim_date dd ON dd.full_date = s.flight_date
  JOIN live_dim_time st ON st.time_value = s.scheduled_departure_time
  LEFT JOIN live_dim_time act ON act.time_value = s.actual_departure_time
  JOIN dim_aircraft ac ON ac.aircraft_type = s.aircraft_type
  JOIN dim_weather_condition w ON w.weather_condition = s.weather_condition
  JOIN dim_delay_cause dc ON dc.delay_cause = s.delay_cause
),
live_src AS (
  SELECT flight_id, date_id, scheduled_departure_time_id, origin_airport_id, destination_airport_id,
    min(seq) AS first_seq, count(*) AS n_rows,
    arg_min(airline_id, seq) AS airline_id, arg_min(aircraft_id, seq) AS aircraft_id,
    arg_min(flight_month, seq) AS flight_month,
    arg_max_null(actual_departure_time_id, seq) AS actual_departure_time_id,
    arg_max_null(weather_condition_id, seq) AS weather_condition_id,
    arg_max_null(delay_cause_id, seq) AS delay_cause_id,
    arg_max_null(delay_minutes, seq) AS delay_minutes, arg_max_null(is_delayed, seq) AS is_delayed
  FROM (SELECT *, row_number() OVER (ORDER BY page, pos) AS seq FROM live_resolved)
  GROUP BY flight_id, date_id, scheduled_departure_time_id, origin_airport_id, destination_airport_id
),
live_merged AS (
  SELECT CAST(CASE WHEN t.flight_performance_id IS NOT NULL THEN t.flight_performance_id
                   ELSE (SELECT max(flight_performance_id) FROM fact) + row_number() OVER (
                     PARTITION BY t.flight_performance_id IS NULL ORDER BY s.first_seq) END AS BIGINT) AS flight_performance_id,
    s.n_rows,
    s.flight_id, coalesce(t.airline_id, s.airline_id) AS airline_id, s.origin_airport_id, s.destination_airport_id,
    s.date_id, s.scheduled_departure_time_id, s.actual_departure_time_id,
    coalesce(t.aircraft_id, s.aircraft_id) AS aircraft_id, s.weather_condition_id, s.delay_cause_id,
    s.delay_minutes, s.is_delayed, coalesce(t.flight_month, s.flight_month) AS flight_month,
    CASE WHEN t.flight_performance_id IS NOT NULL THEN 'updated' ELSE 'inserted' END AS status
  FROM live_src s
  LEFT JOIN fact t USING (flight_id, date_id, scheduled_departure_time_id, origin_airport_id, destination_airport_id)
)"""

# ---------------------------------------------------------------- weather

WEATHER = """
readings AS (
  SELECT 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS airport_code, CAST(ts AS DATE) AS date,
    CAST(hour(ts) AS INTEGER) AS reading_hour,
    sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100.0 AS temperature_2m,
    CAST(count(*) AS DOUBLE) AS relative_humidity_2m,
    max(value) AS precipitation, min(value) AS rain,
    CAST(count(DISTINCT user_id) AS DOUBLE) AS snowfall,
    CAST(max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS DOUBLE) AS weather_code,
    sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) / count(*) AS wind_speed_10m,
    CASE WHEN (user_id % 25) % 2 = 1 THEN CAST(max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS DOUBLE)
    END AS wind_gusts_10m
  FROM events
  GROUP BY user_id % 25, CAST(ts AS DATE), hour(ts)
  HAVING sum(CAST(round(value * 100) AS BIGINT)) % 5 <> 3
),
requests AS (
  SELECT event_id AS request_id, 'NATION_' || CAST(event_id % 25 AS VARCHAR) AS airport_code,
    CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS scheduled_hour
  FROM events
),
nearest AS (
  SELECT * FROM (
    SELECT r.request_id, w.*, row_number() OVER (PARTITION BY r.request_id
      ORDER BY abs(w.reading_hour - r.scheduled_hour), w.reading_hour) AS rn
    FROM requests r JOIN readings w ON w.airport_code = r.airport_code AND w.date = r.date)
  WHERE rn = 1
)"""

# ---------------------------------------------------------------- features


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


_FBASE_COLUMNS, _FBASE_FROM = _star_source("fact AS base", {
    "date_id": ("full_date", "day", "month", "year"),
    "scheduled_departure_time_id": ("hour", "minute", "time_of_day"),
    "airline_id": ("airline_code",),
    "flight_id": ("flight_number", "flight_type", "route_category", "route_distance"),
    "aircraft_id": ("seating_capacity", "aircraft_category"),
    "weather_condition_id": ("weather_condition AS weather_type", "temperature", "wind_speed", "visibility"),
    "origin_airport_id": ("airport_code AS origin_airport_code",),
    "destination_airport_id": ("airport_code AS destination_airport_code",),
})


def flags_of(source: str) -> str:
    """Every row of ``source`` with calendar, clock, season, weather and route flags and the target."""
    return f"""SELECT *,
    CAST(isodow(full_date) - 1 AS INTEGER) AS day_of_week,
    {_flag("isodow(full_date) IN (6, 7)")} AS is_weekend,
    {_flag("hour BETWEEN 0 AND 5")} AS is_night_flight,
    {_flag("hour BETWEEN 6 AND 11")} AS is_morning,
    {_flag("hour BETWEEN 12 AND 17")} AS is_afternoon,
    {_flag("hour BETWEEN 18 AND 23")} AS is_evening,
    {_flag("hour IN (7, 8, 9, 16, 17, 18, 19)")} AS is_peak_hour,
    {_flag("month IN (12, 1, 2)")} AS is_winter,
    {_flag("month IN (6, 7, 8)")} AS is_summer,
    {_flag("month IN (12, 1)")} AS is_holiday_season,
    {_flag("TRY_CAST(visibility AS DOUBLE) < 5")} AS low_visibility,
    {_flag("TRY_CAST(wind_speed AS DOUBLE) > 20")} AS high_wind,
    {_flag("weather_type IN ('Rain', 'Storm', 'Snow', 'Fog', 'Thunderstorm')")} AS bad_weather,
    {_flag("route_distance < 500")} AS short_route,
    {_flag("route_distance BETWEEN 500 AND 1500")} AS medium_route,
    {_flag("route_distance > 1500")} AS long_route,
    CAST(CASE WHEN delay_status IS NOT NULL THEN delay_status = 'Delayed' ELSE coalesce(is_delayed, false) END AS INTEGER)
      AS target_delayed
  FROM {source}"""


def rates_of(source: str) -> str:
    """Every flagged row of ``source`` with the delay rates and (empty) live columns."""
    return f"""  SELECT f.*, ra.airline_delay_rate, ro.origin_delay_rate, rd.destination_delay_rate, rr.route_delay_rate,
    rc.aircraft_delay_rate, rw.weather_delay_rate,
    0.0 AS origin_live_departures_count, 0.0 AS origin_live_arrivals_count, 0.0 AS origin_delayed_departures_count,
    0.0 AS origin_delayed_arrivals_count, 0.0 AS origin_avg_departure_delay, 0.0 AS origin_avg_arrival_delay,
    0.0 AS destination_live_departures_count, 0.0 AS destination_live_arrivals_count,
    0.0 AS destination_delayed_departures_count, 0.0 AS destination_delayed_arrivals_count,
    0.0 AS destination_avg_departure_delay, 0.0 AS destination_avg_arrival_delay,
    coalesce(f.api_departure_delay_minutes, 0) AS departure_delay_minutes_live,
    coalesce(f.api_arrival_delay_minutes, 0) AS arrival_delay_minutes_live,
    coalesce(f.api_live_flight_status, 'Unknown') AS live_flight_status
  FROM {source} f
  LEFT JOIN r_airline ra ON ra.airline_code = f.airline_code
  LEFT JOIN r_origin ro ON ro.origin_airport_code = f.origin_airport_code
  LEFT JOIN r_dest rd ON rd.destination_airport_code = f.destination_airport_code
  LEFT JOIN r_route rr ON rr.origin_airport_code = f.origin_airport_code AND rr.destination_airport_code = f.destination_airport_code
  LEFT JOIN r_aircraft rc ON rc.aircraft_category = f.aircraft_category
  LEFT JOIN r_weather rw ON rw.weather_type = f.weather_type
"""


FEATURES = f"""
fbase AS MATERIALIZED (
  SELECT flight_performance_id, is_delayed, delay_status, CAST(NULL AS INTEGER) AS api_departure_delay_minutes,
    CAST(NULL AS INTEGER) AS api_arrival_delay_minutes, CAST(NULL AS VARCHAR) AS api_live_flight_status, {_FBASE_COLUMNS}
  FROM {_FBASE_FROM}
),
flagged AS MATERIALIZED (
  {flags_of("fbase")}
),
r_airline AS (SELECT airline_code, avg(CAST(target_delayed AS DOUBLE)) AS airline_delay_rate FROM flagged
              WHERE airline_code IS NOT NULL GROUP BY airline_code),
r_origin AS (SELECT origin_airport_code, avg(CAST(target_delayed AS DOUBLE)) AS origin_delay_rate FROM flagged
             WHERE origin_airport_code IS NOT NULL GROUP BY origin_airport_code),
r_dest AS (SELECT destination_airport_code, avg(CAST(target_delayed AS DOUBLE)) AS destination_delay_rate FROM flagged
           WHERE destination_airport_code IS NOT NULL GROUP BY destination_airport_code),
r_route AS (SELECT origin_airport_code, destination_airport_code, avg(CAST(target_delayed AS DOUBLE)) AS route_delay_rate
            FROM flagged WHERE origin_airport_code IS NOT NULL AND destination_airport_code IS NOT NULL
            GROUP BY origin_airport_code, destination_airport_code),
r_aircraft AS (SELECT aircraft_category, avg(CAST(target_delayed AS DOUBLE)) AS aircraft_delay_rate FROM flagged
               WHERE aircraft_category IS NOT NULL GROUP BY aircraft_category),
r_weather AS (SELECT weather_type, avg(CAST(target_delayed AS DOUBLE)) AS weather_delay_rate FROM flagged
              WHERE weather_type IS NOT NULL GROUP BY weather_type),
feat AS (
  {rates_of("flagged")}
)"""

# One request per flight number, half a year after its last flight (another season): the history
# row is the latest one, its calendar fields become those of the requested date, and the flags follow.
SERVED = f"""
served AS (
  SELECT * EXCLUDE (rn, asked) REPLACE (asked AS full_date, CAST(day(asked) AS INTEGER) AS day,
    CAST(month(asked) AS INTEGER) AS month, CAST(year(asked) AS INTEGER) AS year)
  FROM (SELECT h.*, CAST(q.last_date + INTERVAL 180 DAY AS DATE) AS asked,
          row_number() OVER (PARTITION BY q.flight_number ORDER BY h.full_date DESC, h.flight_performance_id DESC) AS rn
        FROM (SELECT flight_number, max(full_date) AS last_date FROM fbase GROUP BY flight_number) q
        JOIN fbase h ON upper(trim(h.flight_number)) = upper(trim(q.flight_number)))
  WHERE rn = 1
),
served_flags AS ({flags_of("served")}),
served_feat AS ({rates_of("served_flags")})"""


def served_select(numeric: list[str], categorical: list[str]) -> str:
    cols = ["flight_number", "flight_performance_id"]
    cols += [f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}" for c in numeric]
    cols += [f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in categorical]
    return "SELECT " + ", ".join(cols) + " FROM served_feat"


def prepared_select(numeric: list[str], categorical: list[str]) -> str:
    cols = ["flight_performance_id"]
    cols += [f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}" for c in numeric]
    cols += [f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in categorical]
    cols += ["CAST(target_delayed AS INTEGER) AS target_delayed"]
    return "SELECT " + ", ".join(cols) + " FROM feat"
