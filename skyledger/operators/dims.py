"""Dimension builds and maintenance: candidates from a batch, seeded members,
insert-if-absent with new surrogate keys, and get-or-create with name refresh (SCD-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from ..functions.clock import part_of_day, time_hour, time_minute
from ..schemas import NATURAL_KEYS, TABLES, conform
from .broadcast import broadcast_if_small
from .dedupe import keep_first, keep_last
from .ids import assign_sequential_ids, max_id

# Seeded default members (reference rules).
AIRCRAFT_DEFAULTS = ["Unknown"]
WEATHER_DEFAULTS = ["Unknown"]
DELAY_CAUSE_DEFAULTS = ["None", "Carrier", "Weather", "NAS", "Security", "Late Aircraft"]
LIVE_DELAY_CAUSE = "API / Live Status"


def date_candidates(dates: DataFrame, date_col: str = "flight_date") -> DataFrame:
    """Distinct non-NULL dates with calendar attributes (Monday = 0)."""
    d = dates.select(F.col(date_col).alias("full_date")).where(F.col("full_date").isNotNull()).distinct()
    return d.select("full_date", *calendar_columns("full_date"))


def time_candidates(times: DataFrame, time_cols: list[str]) -> DataFrame:
    """Distinct non-NULL 'HH:MM:SS' values taken from several columns in one pass."""
    t = (times.select(F.explode(F.array(*[F.col(c) for c in time_cols])).alias("time_value"))
         .where(F.col("time_value").isNotNull()).distinct())
    hour = time_hour("time_value")
    return t.select("time_value", hour.alias("hour"), time_minute("time_value").alias("minute"),
                    part_of_day(hour).alias("time_of_day"))


def flight_candidates(flights: DataFrame, col: str = "flight_number") -> DataFrame:
    return flights.select(F.col(col).cast("string").alias("flight_number")) \
        .where(F.col("flight_number").isNotNull()).distinct()


def airline_candidates(airlines: DataFrame, order_cols: list[str]) -> DataFrame:
    """Raw airline rows renamed; first row per code wins (NULL codes excluded)."""
    renamed = airlines.select(F.col("iata_code").alias("airline_code"),
                              F.col("airline").alias("airline_name"), *order_cols)
    renamed = renamed.where(F.col("airline_code").isNotNull())
    return keep_first(renamed, ["airline_code"], order_cols, keep_order=False)


AIRPORT_FILE_COLUMNS = {"iata_code": "airport_code", "airport": "airport_name", "city": "city",
                        "state": "state", "country": "country", "latitude": "latitude",
                        "longitude": "longitude"}


def airport_candidates(airports: DataFrame, order_cols: list[str]) -> DataFrame:
    """Raw airport rows renamed; columns the file lacks are backfilled as NULL; first per code wins."""
    present = set(airports.columns)
    cols = []
    for src, dst in AIRPORT_FILE_COLUMNS.items():
        dtype = TABLES["dim_airport"][dst].dataType
        cols.append((F.col(src) if src in present else F.lit(None)).cast(dtype).alias(dst))
    renamed = airports.select(*cols, *order_cols).where(F.col("airport_code").isNotNull())
    return keep_first(renamed, ["airport_code"], order_cols, keep_order=False)


def seeded(spark: SparkSession, table: str, values: list[str]) -> DataFrame:
    """Static default members as candidates; ``_seed_pos`` keeps their listed order for ids."""
    _, key = NATURAL_KEYS[table]
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{key} string, _seed_pos int")


def insert_if_absent(target: DataFrame, candidates: DataFrame, table: str,
                     order_cols: list[str] | None = None, target_is_empty: bool = False) -> DataFrame:
    """Target plus the candidates whose natural key is new, numbered after the current max id
    in natural-key order (or ``order_cols``).  Existing rows never change; NULL keys are never
    inserted.  Candidates must already be one row per key."""
    id_col, key = NATURAL_KEYS[table]
    candidates = candidates.where(F.col(key).isNotNull())
    if target_is_empty:
        new, start = candidates, 0
    else:
        new = candidates.join(target.select(key), key, "left_anti")
        start = max_id(target, id_col)
    numbered = assign_sequential_ids(new, order_cols or [key], id_col, start=start)
    return target.unionByName(conform(numbered, TABLES[table]))


def member_usage(tables: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """(table_name, member_id, member, fact_rows) of small dimensions: the fact's rows by member, from one
    grouping-sets aggregation over its keys."""
    keys = list(ids.values())
    counts = (tables["fact_flightperformance"].groupingSets([[k] for k in keys], *keys)
              .agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_gid")))
    out = None
    for i, (table, id_col) in enumerate(ids.items()):
        others = sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)
        used = counts.where(F.col("_gid") == others).select(F.col(id_col).alias("member_id"), "_n")
        part = (tables[table].select(F.lit(table).alias("table_name"), F.col(id_col).alias("member_id"),
                                     F.col(NATURAL_KEYS[table][1]).alias("member"))
                .join(used, "member_id", "left").select("table_name", "member_id", "member", F.coalesce("_n", F.lit(0)).alias("fact_rows")))
        out = part if out is None else out.unionByName(part)
    return out


def tables_with_new_members(tables: dict[str, DataFrame], mentioned: DataFrame) -> set[str]:
    """Names of the dimensions that lack a mentioned member: ``mentioned`` holds (dim, key as text) rows; all
    dimensions are tested in one job, which returns a name each."""
    known = None
    for table, (_, key) in NATURAL_KEYS.items():
        part = tables[table].select(F.lit(table).alias("dim"), F.col(key).cast("string").alias("key"))
        known = part if known is None else known.unionByName(part)
    wanted = mentioned.where(F.col("key").isNotNull()).distinct()
    new = wanted.join(broadcast_if_small(known), ["dim", "key"], "left_anti")
    return {r[0] for r in new.select("dim").distinct().collect()}


def upsert_names(target: DataFrame, batch: DataFrame, table: str, name_col: str,
                 order_cols: list[str]) -> DataFrame:
    """Get-or-create with a name refresh: the last non-blank name in the batch replaces the
    stored one (NULL keeps it); a new key gets its name, or its code when no name came."""
    id_col, key = NATURAL_KEYS[table]
    src = batch.select(key, name_col, *order_cols).where(F.col(key).isNotNull())
    named = src.where(F.col(name_col).isNotNull())
    last_name = keep_last(named, [key], order_cols, keep_order=False)
    keys = src.select(key).distinct()
    incoming = keys.join(last_name, key, "left")

    t = target.alias("t")
    s = incoming.alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    refreshed = joined.where(F.col(f"t.{id_col}").isNotNull()).select(
        *[F.coalesce(F.col(f"s.{name_col}"), F.col(f"t.{name_col}")).alias(c) if c == name_col
          else F.col(f"t.{c}") for c in target.columns])
    fresh = joined.where(F.col(f"t.{id_col}").isNull()).select(
        F.col(f"s.{key}").alias(key),
        F.coalesce(F.col(f"s.{name_col}"), F.col(f"s.{key}")).alias(name_col))
    start = max_id(target, id_col)
    numbered = assign_sequential_ids(fresh, [key], id_col, start=start)
    return refreshed.unionByName(conform(numbered, TABLES[table]))
