"""Model features: calendar / clock / season / weather / route flags, historical delay rates,
live airport aggregates, the 55-column feature contract and its cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as FL
from ..functions.calendar import is_weekend, weekday_mon0
from ..functions.text import UNKNOWN, category
from ..schemas import require_columns
from ..session import stored
from .broadcast import broadcast_if_small
from .star import star_join

# The model's feature contract (reference order).
NUMERIC_FEATURES = [
    "day", "month", "year", "day_of_week", "is_weekend",
    "hour", "minute", "is_night_flight", "is_morning", "is_afternoon", "is_evening", "is_peak_hour",
    "is_winter", "is_summer", "is_holiday_season",
    "temperature", "wind_speed", "visibility", "low_visibility", "high_wind", "bad_weather",
    "route_distance", "short_route", "medium_route", "long_route",
    "seating_capacity",
    "airline_delay_rate", "origin_delay_rate", "destination_delay_rate", "route_delay_rate",
    "aircraft_delay_rate", "weather_delay_rate",
    "origin_live_departures_count", "origin_live_arrivals_count", "origin_delayed_departures_count",
    "origin_delayed_arrivals_count", "origin_avg_departure_delay", "origin_avg_arrival_delay",
    "destination_live_departures_count", "destination_live_arrivals_count",
    "destination_delayed_departures_count", "destination_delayed_arrivals_count",
    "destination_avg_departure_delay", "destination_avg_arrival_delay",
    "departure_delay_minutes_live", "arrival_delay_minutes_live",
]
CATEGORICAL_FEATURES = [
    "time_of_day", "airline_code", "origin_airport_code", "destination_airport_code", "weather_type",
    "flight_type", "route_category", "aircraft_category", "live_flight_status",
]
TARGET = "target_delayed"

# Historical delay-rate features, name -> grouping columns (reference rules).
DELAY_RATE_GROUPS = {
    "airline_delay_rate": ["airline_code"],
    "origin_delay_rate": ["origin_airport_code"],
    "destination_delay_rate": ["destination_airport_code"],
    "route_delay_rate": ["origin_airport_code", "destination_airport_code"],
    "aircraft_delay_rate": ["aircraft_category"],
    "weather_delay_rate": ["weather_type"],
}

LIVE_AIRPORT_COLUMNS = ["live_departures_count", "live_arrivals_count", "delayed_departures_count",
                        "delayed_arrivals_count", "avg_departure_delay", "avg_arrival_delay"]


def feature_columns() -> tuple[list[str], list[str]]:
    return list(NUMERIC_FEATURES), list(CATEGORICAL_FEATURES)


def target_column(df: DataFrame) -> F.Column:
    """1 when the flight is delayed: live rows by their status text, historical rows by flag."""
    status = F.col("delay_status") if "delay_status" in df.columns else F.lit(None).cast("string")
    flag = F.col("is_delayed") if "is_delayed" in df.columns else F.lit(None).cast("boolean")
    return F.when(status.isNotNull(), status == FL.STATUS_DELAYED).otherwise(F.coalesce(flag, F.lit(False))).cast("int")


def add_flags(df: DataFrame) -> DataFrame:
    """Calendar (Monday = 0), clock, season, weather and route 0/1 flags plus the target."""
    d = F.col("full_date").cast("date")
    return df.select(
        *[c for c in df.columns if c not in ("day_of_week", "is_weekend")],
        weekday_mon0(d).alias("day_of_week"),
        FL.as_int(is_weekend(d)).alias("is_weekend"),
        *FL.time_flags("hour"),
        *FL.season_flags("month"),
        *FL.weather_flags("visibility", "wind_speed", "weather_type"),
        *FL.route_flags("route_distance"),
        target_column(df).alias(TARGET),
    )


def delay_rates(fit: DataFrame, groups: dict[str, list[str]] = DELAY_RATE_GROUPS) -> dict[str, DataFrame]:
    """Mean target per group for each rate feature (NULL group keys excluded).

    All rates come from ONE grouping-sets aggregation: a single pass over ``fit`` (instead of
    one star join per rate), partially aggregated map-side, so a hot key (one airline holding a
    third of all flights) never lands whole in one task.  The result has one row per distinct
    key of each set (bounded by airports squared for routes); it is stored so the per-rate
    tables read it instead of re-running the pass."""
    keys = list(dict.fromkeys(k for ks in groups.values() for k in ks))
    agg = (fit.groupingSets([list(ks) for ks in groups.values()], *keys)
           .agg(F.avg(F.col(TARGET).cast("double")).alias("_rate"), F.grouping_id().alias("_gid")))
    agg = stored(agg, "rates")
    out = {}
    for name, ks in groups.items():
        # grouping_id: bit set (most significant first, in ``keys`` order) for columns not grouped
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks)
        cond = F.col("_gid") == gid
        for k in ks:
            cond = cond & F.col(k).isNotNull()
        out[name] = agg.where(cond).select(*ks, F.col("_rate").alias(name))
    return out


def attach_delay_rates(df: DataFrame, fit: DataFrame | None = None, fallback_to_mean: bool = False) -> DataFrame:
    """Join each rate back by its keys (size-checked broadcast, so the fact is not shuffled).

    ``fit`` defaults to ``df`` itself (the reference computes rates over the whole dataset);
    passing the training split gives leak-free rates, optionally with the training mean for
    keys never seen in training."""
    fit = fit if fit is not None else df
    rates = delay_rates(fit)
    out = df
    for name, table in rates.items():
        keys = DELAY_RATE_GROUPS[name]
        out = out.join(broadcast_if_small(table), keys, "left")
    if fallback_to_mean:
        mean = fit.agg(F.avg(F.col(TARGET).cast("double"))).first()[0]
        out = out.fillna({name: float(mean or 0.0) for name in rates})
    return out


def fold_column(key: str, folds: int = 5) -> F.Column:
    """The fold of a row: a hash of its key, so it doesn't depend on the label or on the partitions."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("fold"))), 1, 8), 16, 10).cast("bigint")
    return (h % folds).cast("int")


def attach_out_of_fold_rates(df: DataFrame, fold: str, groups: dict[str, list[str]] = DELAY_RATE_GROUPS) -> DataFrame:
    """Each delay rate of a row from the rows of its key in all other folds, so that no row's label feeds its own
    rate; a key without rows there takes the mean of the other folds' rows, and 0 if there are none.

    One grouping-sets pass gives sums and counts by key and fold; a key's total less the fold's own part is the
    rest (a window over the few folds of a key); the small tables are joined back by key and fold."""
    keys = [*dict.fromkeys(k for ks in groups.values() for k in ks), fold]
    sets = [[*ks, fold] for ks in groups.values()] + [[fold]]
    parts = stored(df.groupingSets(sets, *keys).agg(F.sum(F.col(TARGET).cast("bigint")).alias("_s"), F.count(F.lit(1)).alias("_n"),
                                                    F.grouping_id().alias("_gid")), "folds")

    def rest(ks: list[str], name: str) -> DataFrame:
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks and k != fold)
        mine = parts.where(F.col("_gid") == gid).where(" and ".join(f"{k} is not null" for k in [*ks, fold]))
        every = Window.partitionBy(*ks)
        n = F.sum("_n").over(every) - F.col("_n")
        return mine.select(*ks, fold, F.when(n > 0, (F.sum("_s").over(every) - F.col("_s")) / n).alias(name))

    out = df.join(F.broadcast(rest([], "_mean")), fold, "left")          # one row a fold
    for name, ks in groups.items():
        out = out.join(broadcast_if_small(rest(ks, name)), [*ks, fold], "left")
    return out.withColumns({n: F.coalesce(n, "_mean", F.lit(0.0)) for n in groups}).drop("_mean")


def live_airport_aggregates(fact_live: DataFrame, airport_key: str = "airport_id") -> DataFrame:
    """Per airport from live rows: departures / arrivals, delayed departures / arrivals
    (delay > 15), mean departure / arrival delay.  One pass: every live row yields its origin
    (departure) and destination (arrival) role through a two-element explode, then a single
    partial aggregation per airport.  A side an airport never had stays NULL (as a full outer
    join of the two per-role aggregates would leave it)."""
    role = F.explode(F.array(
        F.struct(F.col("origin_airport_id").alias("_a"), F.lit(True).alias("_dep"),
                 F.col("api_departure_delay_minutes").alias("_d")),
        F.struct(F.col("destination_airport_id").alias("_a"), F.lit(False).alias("_dep"),
                 F.col("api_arrival_delay_minutes").alias("_d"))))
    rows = fact_live.select(role.alias("_r")).select("_r.*")
    dep, arr = F.col("_dep"), ~F.col("_dep")
    late = F.coalesce(F.col("_d"), F.lit(0)) > 15
    agg = rows.groupBy(F.col("_a").alias(airport_key)).agg(
        F.count(F.when(dep, 1)).alias("_nd"), F.count(F.when(arr, 1)).alias("_na"),
        F.count(F.when(dep & late, 1)).alias("_ld"), F.count(F.when(arr & late, 1)).alias("_la"),
        F.avg(F.when(dep, F.col("_d"))).alias("avg_departure_delay"),
        F.avg(F.when(arr, F.col("_d"))).alias("avg_arrival_delay"))
    has_d, has_a = F.col("_nd") > 0, F.col("_na") > 0
    return agg.select(airport_key,
                      F.when(has_d, F.col("_nd")).alias("live_departures_count"),
                      F.when(has_a, F.col("_na")).alias("live_arrivals_count"),
                      F.when(has_d, F.col("_ld")).alias("delayed_departures_count"),
                      F.when(has_a, F.col("_la")).alias("delayed_arrivals_count"),
                      "avg_departure_delay", "avg_arrival_delay")


def attach_live_features(df: DataFrame, live: DataFrame) -> DataFrame:
    """Origin and destination live aggregates plus the flight's own live columns (missing -> 0 / Unknown)."""
    b = broadcast_if_small(live)
    out = df
    for role in ("origin", "destination"):
        r = b.select(F.col("airport_id").alias(f"{role}_airport_id"),
                     *[F.col(c).alias(f"{role}_{c}") for c in LIVE_AIRPORT_COLUMNS])
        out = out.join(r, f"{role}_airport_id", "left")
    fill = {f"{role}_{c}": 0 for role in ("origin", "destination") for c in LIVE_AIRPORT_COLUMNS}
    out = out.withColumns({k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in fill})
    return out.withColumns({
        "departure_delay_minutes_live": F.coalesce(F.col("api_departure_delay_minutes"), F.lit(0)),
        "arrival_delay_minutes_live": F.coalesce(F.col("api_arrival_delay_minutes"), F.lit(0)),
        "live_flight_status": F.coalesce(F.col("api_live_flight_status"), F.lit(UNKNOWN)),
    })


def training_dataset(tables: dict[str, DataFrame], live_source: str = "Aviationstack") -> DataFrame:
    """Star join + flags + target + delay rates + live aggregates: one row per fact row."""
    fact = tables["fact_flightperformance"]
    star = star_join(tables, fact)
    flagged = add_flags(star)
    live = stored(live_airport_aggregates(fact.where(F.col("api_source") == live_source)), "live")
    return attach_live_features(attach_delay_rates(flagged), live)


def prepare_features(df: DataFrame) -> DataFrame:
    """The 46 numeric features coerced to double (non-numbers -> 0), the 9 categorical ones
    as text with NULL -> 'Unknown', and the target; errors if any contract column is missing."""
    require_columns(df, NUMERIC_FEATURES + CATEGORICAL_FEATURES + [TARGET], "ML training")
    keep = [c for c in ("flight_performance_id",) if c in df.columns]
    types = dict(df.dtypes)
    return df.select(*keep,
                     *[FL.to_number(c, types[c]).alias(c) for c in NUMERIC_FEATURES],
                     *[category(c).alias(c) for c in CATEGORICAL_FEATURES],
                     F.col(TARGET).cast("int").alias(TARGET))


def conform_for_model(df: DataFrame) -> DataFrame:
    """Serving-side cleaning: add missing contract columns (categorical 'Unknown', numeric 0),
    booleans -> 0/1, coerce, and order the columns as the model expects."""
    out = df
    for c in NUMERIC_FEATURES:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
        elif dict(out.dtypes)[c] == "boolean":
            out = out.withColumn(c, F.col(c).cast("int"))
    for c in CATEGORICAL_FEATURES:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(UNKNOWN))
    keep = [c for c in ("request_id", "flight_number", "flight_performance_id") if c in out.columns]
    types = dict(out.dtypes)
    return out.select(*keep, *[FL.to_number(c, types[c]).alias(c) for c in NUMERIC_FEATURES],
                      *[category(c).alias(c) for c in CATEGORICAL_FEATURES])
