"""Flight-shaped inputs derived from the driver's TPC-H-like tables.

No flight data ships with the reference, so the historical load runs on a deterministic view:

* one flight per ``lineitem`` row; airline from the part type, origin/destination from the
  supplier's / customer's nation, date from the order date, clocks and delays by arithmetic
  (injecting NULLs, the 24:00 clock and fractional delays the cleaning rules must handle);
* airlines from ``part`` (one row per part, many duplicates — exercises keep-first);
* airports from ``nation`` x ``region`` (no ``state`` column — exercises column backfill).

The same definitions exist as SQL in :mod:`skyledger.oracle` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order over flights standing in for file order (unique at every scale).
FLIGHT_ORDINAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
AIRLINE_ORDINAL = ["p_partkey"]
AIRPORT_ORDINAL = ["n_nationkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nations(spark, sf_dir, prefix):
    # nation has 25 rows by definition of the benchmark: a proven broadcast bound.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return F.broadcast(n.select(F.col("n_nationkey").alias(f"{prefix}_nationkey"),
                                F.col("n_name").alias(f"{prefix}_name")))


def _flight_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its order, part, supplier, customer and both nations."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.upper(F.substring("p_type", 1, 2)).alias("p_carrier"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # the customer joins the orders, of which there are far fewer than lines; lines move for parts (if those are too many to
    # broadcast) and once by order key, the distribution that both the join with orders and the pages by order need
    placed = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "o_orderdate", "c_nationkey")
    lines = (li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey")
             .join(supp, F.col("l_suppkey") == supp.s_suppkey).drop("s_suppkey").repartition("l_orderkey"))
    return (lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(_nations(spark, sf_dir, "sn"), F.col("s_nationkey") == F.col("sn_nationkey"))
            .join(_nations(spark, sf_dir, "cn"), F.col("c_nationkey") == F.col("cn_nationkey")))


def _flight_columns() -> list:
    carrier = F.col("p_carrier")
    supp_txt = F.col("l_suppkey").cast("string")
    no_actual = F.col("l_linenumber") == 7
    hour_base = (F.col("l_partkey") % 24) * 100
    return [
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.dayofmonth("o_orderdate").alias("day"),
        carrier.alias("airline"),
        F.when(F.col("p_size") % 7 == 0, supp_txt).otherwise(F.concat(carrier, supp_txt)).alias("flight_number"),
        F.col("sn_name").alias("origin_airport"),
        F.col("cn_name").alias("destination_airport"),
        F.when(F.col("l_partkey") % 101 == 0, F.lit(None).cast("bigint"))
         .when(F.col("l_partkey") % 97 == 0, F.lit(2400).cast("bigint"))
         .otherwise(hour_base + F.col("l_suppkey") % 60).alias("scheduled_departure"),
        F.when(no_actual, F.lit(None).cast("bigint"))
         .otherwise(hour_base + (F.col("l_suppkey") + F.col("l_quantity").cast("bigint")) % 60)
         .alias("departure_time"),
        F.when(no_actual, F.lit(None).cast("double"))
         .otherwise(F.datediff("l_shipdate", "o_orderdate").cast("double") + F.col("l_discount") * 10)
         .alias("departure_delay"),
    ]


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flights (lower-case columns of the flights file) plus the ordinal columns."""
    return _flight_base(spark, sf_dir).select(*_flight_columns(), *FLIGHT_ORDINAL)


def live_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed live-API pages: one JSON document ``{"data": [...]}`` per order, a record for each of its
    lines, in line order.  Records re-observe historical
    flights with new delays (updates), move some to a new scheduled second (inserts), and carry
    the defects the ingest must handle: empty flight code, missing arrival code, missing or
    malformed scheduled time, missing names and delays."""
    from ..functions.clock import hhmm_to_time
    # the day and the clocks first: a record reads each of them several times and doesn't compute it again
    f = _flight_base(spark, sf_dir).select("*", *_flight_columns()).withColumns({
        "_day": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "_scheduled": hhmm_to_time("scheduled_departure"), "_actual": hhmm_to_time("departure_time")})
    ln = F.col("l_linenumber")
    day_txt, sched, actual = F.col("_day"), F.col("_scheduled"), F.col("_actual")
    sched_txt = (F.when(sched.isNull(), F.lit(None).cast("string"))
                 .when((ln == 5) & (F.col("l_partkey") % 3 == 0), F.lit("bad-timestamp"))
                 .otherwise(F.concat(day_txt, F.lit("T"),
                                     F.when(ln == 2, F.concat(F.substring(sched, 1, 5), F.lit(":30"))).otherwise(sched),
                                     F.when(ln % 2 == 0, F.lit("Z")).otherwise(F.lit("+02:00")))))
    actual_txt = F.when(actual.isNotNull(), F.concat(day_txt, F.lit("T"), actual, F.lit("+05:30")))
    rec = F.struct(
        F.when(F.col("l_linestatus") == "F", F.lit("landed")).otherwise(F.lit("active")).alias("flight_status"),
        F.struct(F.when(F.col("l_partkey") % 13 == 0, F.lit("")).otherwise(F.col("flight_number")).alias("iata")).alias("flight"),
        F.struct(F.col("airline").alias("iata"),
                 F.when(ln == 1, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("name")).alias("airline"),
        F.struct(F.col("origin_airport").alias("iata"),
                 F.when(ln == 2, F.lit(None).cast("string")).otherwise(F.concat("origin_airport", F.lit(" Intl"))).alias("airport"),
                 F.when(ln == 3, F.lit(None).cast("int")).otherwise((F.col("l_tax") * 1000).cast("int") - 20).alias("delay"),
                 sched_txt.alias("scheduled"), actual_txt.alias("actual")).alias("departure"),
        F.struct(F.when(F.col("l_partkey") % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("destination_airport")).alias("iata"),
                 F.concat("destination_airport", F.lit(" Intl")).alias("airport"),
                 F.when(ln == 4, F.lit(None).cast("int")).otherwise((F.col("l_discount") * 1000).cast("int")).alias("delay"),
                 F.concat(day_txt, F.lit("T23:00:00Z")).alias("scheduled"),
                 F.lit(None).cast("string").alias("actual")).alias("arrival"),
    )
    # one page per order (a bounded group: the lines of one order), records in ordinal order
    items = f.groupBy(F.col("l_orderkey").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(F.struct(*FLIGHT_ORDINAL[1:]).alias("pos"), rec.alias("rec")))).alias("items"))
    return items.select("page", F.to_json(F.struct(F.transform("items", lambda x: x["rec"]).alias("data"))).alias("payload"))


WEATHER_STATIONS = 25   # stations NATION_0 .. NATION_24, keyed by user_id % 25


def _station(c):
    return F.concat(F.lit("NATION_"), (F.col(c) % WEATHER_STATIONS).cast("string"))


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly station readings aggregated from all events.  ``dated`` is false for about a fifth of them, by
    their own values: such a reading reaches the payload without its time, so lookups must fall back to a
    neighbouring hour."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    g = e.groupBy(_station("user_id").alias("airport_code"), F.to_date("ts").alias("date"),
                  F.hour("ts").alias("reading_hour")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("_cents"),
        F.count(F.lit(1)).alias("_n"),
        F.max("value").alias("precipitation"),
        F.min("value").alias("rain"),
        F.countDistinct("user_id").cast("double").alias("snowfall"),
        F.max(k).cast("double").alias("weather_code"),
        F.sum(k).alias("_ksum"),
        F.max(k).alias("_kmax"))
    return g.select(
        "airport_code", "date", "reading_hour", (F.col("_cents") % 5 != 3).alias("dated"),
        (F.col("_cents") / F.col("_n") / 100.0).alias("temperature_2m"),
        F.col("_n").cast("double").alias("relative_humidity_2m"),
        "precipitation", "rain", "snowfall", "weather_code",
        (F.col("_ksum") / F.col("_n")).alias("wind_speed_10m"),
        F.col("_kmax").cast("double").alias("wind_gusts_10m"))


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed weather payload text per station-day: ``{"airport_code", "date", "hourly": {...}}``
    with parallel arrays in hour order, some times null; even-numbered stations omit ``wind_gusts_10m``."""
    from .weather_json import WEATHER_METRICS
    r = weather_readings(spark, sf_dir)
    time_txt = F.when(F.col("dated"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T"),
                                               F.lpad(F.col("reading_hour").cast("string"), 2, "0"), F.lit(":00")))
    per_day = r.groupBy("airport_code", "date").agg(   # at most 24 readings per group
        F.sort_array(F.collect_list(F.struct("reading_hour", time_txt.alias("time"), *WEATHER_METRICS))).alias("h"))
    station_no = F.regexp_extract("airport_code", r"(\d+)$", 1).cast("int")
    arrays = [F.transform("h", lambda x: x["time"]).alias("time")]
    def field(name):
        return lambda x: x[name]

    for m in WEATHER_METRICS:
        arr = F.transform("h", field(m))
        if m == "wind_gusts_10m":
            arr = F.when(station_no % 2 == 1, arr)
        arrays.append(arr.alias(m))
    return per_day.select(F.to_json(F.struct(
        "airport_code", F.date_format("date", "yyyy-MM-dd").alias("date"), F.struct(*arrays).alias("hourly"))).alias("payload"))


def weather_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures needing weather: every event as (request, station, date, hour)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("request_id"), _station("event_id").alias("airport_code"),
                    F.to_date("ts").alias("date"), F.hour("ts").alias("scheduled_hour"))


def airlines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return part.select(F.upper(F.substring("p_type", 1, 2)).alias("iata_code"),
                       F.col("p_type").alias("airline"), "p_partkey")


def airports_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport file without a ``state`` column (it is backfilled as NULL downstream)."""
    nation = table(spark, sf_dir, "nation")
    region = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("iata_code"),
        F.concat(F.col("n_name"), F.lit(" Intl")).alias("airport"),
        F.initcap(F.col("n_name")).alias("city"),
        F.col("r_name").alias("country"),
        (F.col("n_nationkey") * 1.5).alias("latitude"),
        (F.col("n_regionkey") * -10.0).alias("longitude"),
        "n_nationkey",
    )
