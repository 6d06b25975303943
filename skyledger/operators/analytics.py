"""Dashboard analytics over the star: column standardisation, filters, KPIs, group-bys,
top routes, option lists, lookups and table counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_code, is_valid_flight_number, route_label

# Fixed values (reference rules).
MIN_ROUTE_FLIGHTS = 10
TOP_ROUTES = 10
DEFAULT_AIRLINE_PICKS = 5
LIVE_SOURCE = "Aviationstack"
# The star columns the dashboard reads (everything its fallback chain resolves to).
DASHBOARD_STAR_COLUMNS = ["flight_performance_id", "delay_minutes", "is_delayed", "full_date", "year", "month",
                          "hour", "origin_airport_code", "destination_airport_code", "airline_code", "airline_name"]


def dashboard_frame(star: DataFrame) -> DataFrame:
    """Standardise the star's columns for the dashboard, resolving fallbacks at plan time:
    departure delay <- departure_delay | departure_delay_minutes | delay_minutes | 0, hour,
    airport display codes, airline display name, year/month, and a row id."""
    cols = star.columns

    def pick(options, default):
        return next((F.col(c) for c in options if c in cols), F.lit(default))

    out = star.select(
        "*",
        pick(["departure_delay", "departure_delay_minutes", "delay_minutes"], 0).alias("_dep"),
        pick(["arrival_delay", "arrival_delay_minutes"], 0).alias("_arr"),
        pick(["departure_hour", "hour"], 0).alias("_hour"),
        pick(["origin_airport", "origin_airport_code"], "Unknown").alias("_orig"),
        pick(["destination_airport", "destination_airport_code"], "Unknown").alias("_dest"),
        pick(["airline_name", "airline_code"], "Unknown").alias("_airline"),
        (F.col("year") if "year" in cols else F.year("full_date")).alias("_year"),
        (F.col("month") if "month" in cols else F.month("full_date")).alias("_month"),
    )
    out = out.drop(*[c for c in ["departure_delay", "arrival_delay", "departure_hour", "origin_airport",
                                 "destination_airport", "airline_name", "year", "month"] if c in cols])
    out = out.withColumnsRenamed({"_dep": "departure_delay", "_arr": "arrival_delay", "_hour": "departure_hour",
                                  "_orig": "origin_airport", "_dest": "destination_airport",
                                  "_airline": "airline_name", "_year": "year", "_month": "month"})
    if "is_delayed" not in cols:
        out = out.withColumn("is_delayed", F.col("departure_delay") > 15)
    return out


def airline_options(frame: DataFrame) -> DataFrame:
    """Distinct non-NULL airline display names (sorted when shown)."""
    return frame.select("airline_name").where(F.col("airline_name").isNotNull()).distinct().orderBy("airline_name")


def year_options(frame: DataFrame) -> DataFrame:
    return frame.select("year").where(F.col("year").isNotNull()).distinct().orderBy("year")


def default_airlines(frame: DataFrame, k: int = DEFAULT_AIRLINE_PICKS) -> DataFrame:
    """The dashboard's initial airline selection: the first ``k`` names in sort order
    (all of them when there are ``k`` or fewer).  Tiny: at most k rows."""
    return airline_options(frame).limit(k)


def apply_filters(frame: DataFrame, years: DataFrame | list | None = None,
                  airlines: DataFrame | list | None = None) -> DataFrame:
    """Keep rows whose year and airline are selected (NULLs never match).  A selection given
    as a DataFrame becomes a semi join; ``None`` selects every non-NULL value."""
    out = frame
    for col, sel in (("year", years), ("airline_name", airlines)):
        if sel is None:
            out = out.where(F.col(col).isNotNull())
        elif isinstance(sel, DataFrame):
            out = out.join(sel.select(col).distinct(), col, "left_semi")
        else:
            out = out.where(F.col(col).isin(list(sel)))
    return out


def _rate(delayed: str, total: str):
    return F.col(delayed) / F.col(total) * 100


def kpi_summary(frame: DataFrame) -> DataFrame:
    """Total flights, delayed flights, delay rate % (0 when empty), mean departure delay."""
    agg = frame.agg(F.count(F.lit(1)).alias("total_flights"),
                    F.coalesce(F.sum(F.col("is_delayed").cast("bigint")), F.lit(0)).alias("delayed_flights"),
                    F.avg("departure_delay").alias("avg_departure_delay"))
    return agg.select("total_flights", "delayed_flights",
                      F.when(F.col("total_flights") > 0, _rate("delayed_flights", "total_flights"))
                      .otherwise(F.lit(0.0)).alias("delay_rate"),
                      "avg_departure_delay")


def delay_by_airline(frame: DataFrame) -> DataFrame:
    g = frame.where(F.col("airline_name").isNotNull()).groupBy("airline_name").agg(
        F.count("flight_performance_id").alias("total_flights"),
        F.sum(F.col("is_delayed").cast("bigint")).alias("delayed_flights"))
    return g.withColumn("delay_rate", _rate("delayed_flights", "total_flights")).orderBy(F.desc("delay_rate"), "airline_name")


def delay_by_month(frame: DataFrame) -> DataFrame:
    g = frame.where(F.col("month").isNotNull()).groupBy("month").agg(
        F.count("flight_performance_id").alias("total_flights"),
        F.sum(F.col("is_delayed").cast("bigint")).alias("delayed_flights"),
        F.avg("departure_delay").alias("avg_departure_delay"))
    return g.withColumn("delay_rate", _rate("delayed_flights", "total_flights")).orderBy("month")


def delay_by_hour(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("departure_hour").isNotNull()).groupBy("departure_hour").agg(
        F.avg("departure_delay").alias("avg_departure_delay")).orderBy("departure_hour")


def route_delays(frame: DataFrame, min_flights: int = MIN_ROUTE_FLIGHTS) -> DataFrame:
    """Per 'origin → destination' route: flights and mean delay, routes with enough flights."""
    g = frame.groupBy(route_label("origin_airport", "destination_airport").alias("route")).agg(
        F.count("flight_performance_id").alias("total_flights"),
        F.avg("departure_delay").alias("avg_departure_delay"))
    return g.where(F.col("total_flights") >= min_flights)


def top_routes(frame: DataFrame, n: int = TOP_ROUTES, min_flights: int = MIN_ROUTE_FLIGHTS) -> DataFrame:
    """Top ``n`` routes by mean delay (ties broken by route text), via TakeOrderedAndProject."""
    return route_delays(frame, min_flights).orderBy(F.desc("avg_departure_delay"), "route").limit(n)


def available_flights(star: DataFrame) -> DataFrame:
    """Distinct bookable flights: cleaned flight numbers matching carrier + digits, with
    airline, airports and date (missing columns become NULL)."""
    cols = star.columns
    fn = clean_code("flight_number")
    picked = [F.col(c) if c in cols else F.lit(None).cast("string").alias(c)
              for c in ["airline_code", "origin_airport_code", "destination_airport_code", "full_date"]]
    return (star.where(is_valid_flight_number("flight_number"))
            .select(fn.alias("flight_number"), *picked).distinct())


def lookup_many(df: DataFrame, requests: DataFrame, column: str, order_by: str) -> DataFrame:
    """Set-based form of many single-key lookups: one row per requested key (first by
    ``order_by``), via a keep-first aggregation instead of one query per key."""
    from .dedupe import keep_first
    hits = df.join(requests.select(column).distinct(), column, "left_semi")
    return keep_first(hits, [column], [order_by])


def table_counts(tables: dict[str, DataFrame], live_source: str = LIVE_SOURCE) -> DataFrame:
    """Row counts of the fact and three dimensions, plus the live (API) fact rows."""
    parts = [tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(label).alias("table_name"), "row_count")
             for label, name in [("fact_flightperformance", "fact_flightperformance"),
                                 ("dim_airline", "dim_airline"), ("dim_airport", "dim_airport"),
                                 ("dim_date", "dim_date")]]
    parts.append(tables["fact_flightperformance"].where(F.col("api_source") == live_source)
                 .agg(F.count(F.lit(1)).alias("row_count"))
                 .select(F.lit("live_fact_rows").alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def year_airline_summary(frame: DataFrame) -> DataFrame:
    """The dashboard's base: flights, delayed flights, and sum and count of delays by year and
    airline.  Options, default picks and the KPIs of any selection come from this small table."""
    return frame.groupBy("year", "airline_name").agg(
        F.count(F.lit(1)).alias("flights"), F.sum(F.col("is_delayed").cast("bigint")).alias("delayed"),
        F.sum(F.col("departure_delay").cast("bigint")).alias("delay_sum"), F.count("departure_delay").alias("delay_count"))


def kpis_of_summary(summary: DataFrame) -> DataFrame:
    """The KPIs over (a selection of) the summary's rows."""
    total = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("flights", "delayed", "delay_sum", "delay_count")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return total.select(F.col("flights").alias("total_flights"), F.col("delayed").alias("delayed_flights"),
                        F.coalesce(share("delayed", "flights") * 100, F.lit(0.0)).alias("delay_rate"),
                        share("delay_sum", "delay_count").alias("avg_departure_delay"))
