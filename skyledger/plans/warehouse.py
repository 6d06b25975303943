"""Historical load: raw flights / airlines / airports -> eight dimensions + the fact.

``transform_and_load`` is the whole job as lazy DataFrames over a (possibly empty) existing
warehouse; ``write_warehouse`` commits it as a new version (fact partitioned by ``flight_month``, only
files that hold a changed row rewritten); ``warehouse_for`` builds the test-bed warehouse of a driver data folder
once per session and serves later queries from the written tables.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dims as D
from ..operators.merge import FactMerge, run_counters, untouched_rows, upsert_fact
from ..operators.resolve import resolve_keys
from ..operators.staging import malformed_rows, stage_flights
from ..schemas import TABLES, empty_table
from ..session import scratch_path, stored, tune_session
from ..sources import testbed
from ..sources.files import cap_rows
from ..sources.storage import entries, remove_folder

DIM_TABLES = [t for t in TABLES if t.startswith("dim_")]
# A fixed load timestamp keeps test output reproducible; jobs pass their own.
DEFAULT_RUN_TS = "2024-01-01 00:00:00"


@dataclass
class LoadResult:
    tables: dict[str, DataFrame]          # full content after the load
    merge: FactMerge                      # what it changed in the fact
    changed_dims: list[str]               # dimensions that got new members
    unresolved: DataFrame                 # rows dropped by key resolution, with reason
    malformed: DataFrame                  # rows with unreadable clocks / dates, with reason
    staged: DataFrame = field(repr=False, default=None)

    def counters(self) -> DataFrame:
        return run_counters(self.merge.statuses, self.unresolved)


def run_timestamp(value: str | None = None) -> Column:
    return F.lit(value or DEFAULT_RUN_TS).cast("timestamp_ntz")


class _Tables(dict):
    """Table dict that remembers whether it is a brand-new (empty) warehouse."""
    fresh = False


def empty_warehouse(spark: SparkSession) -> dict[str, DataFrame]:
    tables = _Tables({name: empty_table(spark, name) for name in TABLES})
    tables.fresh = True
    return tables


def load_dimensions(spark: SparkSession, current: dict[str, DataFrame], staged: DataFrame,
                    airlines: DataFrame, airline_order: list[str],
                    airports: DataFrame, airport_order: list[str]) -> dict[str, DataFrame]:
    """Insert-if-absent for all eight dimensions (stored: every fact role reads them)."""
    out = _Tables(current)
    fresh = getattr(current, "fresh", False)
    out["dim_airline"] = D.insert_if_absent(current["dim_airline"], D.airline_candidates(airlines, airline_order), "dim_airline", target_is_empty=fresh)
    out["dim_airport"] = D.insert_if_absent(current["dim_airport"], D.airport_candidates(airports, airport_order), "dim_airport", target_is_empty=fresh)
    out["dim_date"] = D.insert_if_absent(current["dim_date"], D.date_candidates(staged), "dim_date", target_is_empty=fresh)
    out["dim_time"] = D.insert_if_absent(current["dim_time"], D.time_candidates(
        staged, ["scheduled_departure_time", "actual_departure_time"]), "dim_time", target_is_empty=fresh)
    out["dim_flight"] = D.insert_if_absent(current["dim_flight"], D.flight_candidates(staged), "dim_flight", target_is_empty=fresh)
    out["dim_aircraft"] = D.insert_if_absent(current["dim_aircraft"], D.seeded(spark, "dim_aircraft", D.AIRCRAFT_DEFAULTS),
                                             "dim_aircraft", ["_seed_pos"], target_is_empty=fresh)
    out["dim_weather_condition"] = D.insert_if_absent(current["dim_weather_condition"], D.seeded(
        spark, "dim_weather_condition", D.WEATHER_DEFAULTS), "dim_weather_condition", ["_seed_pos"], target_is_empty=fresh)
    out["dim_delay_cause"] = D.insert_if_absent(current["dim_delay_cause"], D.seeded(
        spark, "dim_delay_cause", D.DELAY_CAUSE_DEFAULTS), "dim_delay_cause", ["_seed_pos"], target_is_empty=fresh)
    for name in DIM_TABLES:
        out[name] = stored(out[name], name)
    return out


def transform_and_load(spark: SparkSession, flights: DataFrame, flight_order: list[str],
                       airlines: DataFrame, airline_order: list[str],
                       airports: DataFrame, airport_order: list[str],
                       current: dict[str, DataFrame] | None = None,
                       run_ts: str | None = None, row_cap: int | None = None) -> LoadResult:
    """The historical ETL as one lazy plan per table."""
    current = current or empty_warehouse(spark)
    flights = cap_rows(flights, row_cap, flight_order)
    staged = stored(stage_flights(flights, flight_order), "staged")
    tables = load_dimensions(spark, current, staged, airlines, airline_order, airports, airport_order)
    resolved, unresolved = resolve_keys(staged, tables)
    fact = current["fact_flightperformance"]
    merge = upsert_fact(fact, resolved, flight_order, run_timestamp(run_ts), target_is_empty=getattr(current, "fresh", False))
    tables["fact_flightperformance"] = untouched_rows(fact, merge).unionByName(merge.affected)
    return LoadResult(tables, merge, list(DIM_TABLES), unresolved, malformed_rows(staged), staged)


def testbed_load(spark: SparkSession, sf_dir: str, run_ts: str | None = None,
                 row_cap: int | None = None) -> LoadResult:
    """Historical load of the flight-shaped view of a driver data folder into an empty warehouse."""
    return transform_and_load(
        spark,
        testbed.flights_raw(spark, sf_dir), testbed.FLIGHT_ORDINAL,
        testbed.airlines_raw(spark, sf_dir), testbed.AIRLINE_ORDINAL,
        testbed.airports_raw(spark, sf_dir), testbed.AIRPORT_ORDINAL,
        run_ts=run_ts, row_cap=row_cap)


# ---------------------------------------------------------------- versioned warehouse folders

def write_warehouse(result: LoadResult, path: str, batch_id: int | None = None) -> dict:
    """Commit a load to a warehouse folder.

    Dimensions with new members and the fact rows of touched files go to folders of a new version; then one
    small manifest names, for each dimension, its version, and for each month its versions and the files of
    them that later versions replace.  Readers follow the newest manifest, so a job that dies before it leaves
    the warehouse as it was, and nothing is ever overwritten while it is read.  The manifest records
    ``batch_id``: a batch committed once is not committed again.
    """
    spark = result.merge.affected.sparkSession
    last = read_manifest(spark, path) or {"version": 0, "batch_id": None, "dims": {}, "months": {}}
    if batch_id is not None and last["batch_id"] is not None and batch_id <= last["batch_id"]:
        return last
    version = uuid.uuid4().hex
    changed = [n for n in DIM_TABLES if n in result.changed_dims or n not in last["dims"]]
    for name in changed:
        result.tables[name].write.parquet(f"{path}/{name}/version={version}")
    # rebalance lets adaptive execution size the write tasks: small months share a task and get one
    # file each, a month above the advisory size is split over several
    folder = f"{path}/fact_flightperformance/version={version}"
    result.merge.affected.hint("rebalance", "flight_month").write.option("compression", "zstd").partitionBy("flight_month").parquet(folder)
    written = [e.name.split("=")[1] for e in entries(spark, folder) if e.folder and e.name.startswith("flight_month=")]
    months = {m: {v: list(gone) for v, gone in versions.items()} for m, versions in last["months"].items()}
    for file in result.merge.files or []:
        *_, held_by, month, name = file.split("/")
        months[month.split("=")[1]][held_by.split("=")[1]].append(name)
    for month in written:
        kept = months.get(month, {}) if result.merge.files is not None else {}
        months[month] = kept | {version: []}
    manifest = {"version": last["version"] + 1, "batch_id": batch_id if batch_id is not None else last["batch_id"],
                "dims": last["dims"] | {n: version for n in changed}, "months": months}
    spark.createDataFrame([(manifest_text(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest/{manifest['version']:012d}")
    return manifest


def manifest_text(manifest: dict) -> str:
    return json.dumps(manifest)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest of a warehouse folder; None if there is none yet.  Manifests are found by the names
    of their folders, and only the newest complete one is read."""
    for e in reversed(entries(spark, f"{path}/manifest")):
        if any(x.name == "_SUCCESS" for x in entries(spark, e.path)):
            return json.loads(spark.read.text(e.path).first()["value"])
    return None


def read_warehouse(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a warehouse folder as its newest manifest has them."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return empty_warehouse(spark)
    tables = {n: spark.read.schema(TABLES[n]).parquet(f"{path}/{n}/version={v}") for n, v in manifest["dims"].items()}
    base = f"{path}/fact_flightperformance"
    folders = [f"{base}/version={v}/flight_month={m}" for m, versions in sorted(manifest["months"].items()) for v in versions]
    replaced = [name for versions in manifest["months"].values() for gone in versions.values() for name in gone]
    fact = TABLES["fact_flightperformance"]
    if folders:
        rows = (spark.read.schema(T.StructType([*fact.fields, T.StructField("version", T.StringType())]))
                .option("basePath", base).parquet(*folders))
        if replaced:        # a filter on the file's name is settled when files are listed: they are not opened
            rows = rows.where(~F.col("_metadata.file_name").isin(replaced))
        tables["fact_flightperformance"] = rows.select(*fact.names)
    else:
        tables["fact_flightperformance"] = empty_table(spark, "fact_flightperformance")
    return tables


def remove_old_versions(spark: SparkSession, path: str, grace_seconds: float = 7 * 86400.0) -> list[str]:
    """Remove the version folders that the newest manifest doesn't name and that are older than the grace period
    (readers of an older manifest have that long), and manifests as old but the newest; returns what was removed.
    A folder that a running commit writes is younger than that."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return []
    named = {n: {v} for n, v in manifest["dims"].items()}
    named["fact_flightperformance"] = {v for versions in manifest["months"].values() for v in versions}
    before = (time.time() - grace_seconds) * 1000
    old = [e for n, versions in named.items() for e in entries(spark, f"{path}/{n}")
           if e.name.startswith("version=") and e.name.split("=")[1] not in versions and e.modified_ms < before]
    old += [e for e in entries(spark, f"{path}/manifest") if e.name < f"{manifest['version']:012d}" and e.modified_ms < before]
    for e in old:
        remove_folder(spark, e.path)
    return [e.path for e in old]


def source_signature(spark: SparkSession, sf_dir: str) -> str:
    """Files, sizes and times of a data folder, from its listing."""
    parts = [sf_dir.rstrip("/")]
    for name in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region"):
        parts += [f"{e.path}:{e.size}:{e.modified_ms}" for e in entries(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")]
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


_BUILT: dict[tuple[str, str], str] = {}


def warehouse_for(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The test-bed warehouse of ``sf_dir``: loaded and written once per application to the shared
    scratch folder, then read back (so analytics queries scan Parquet, not the ETL lineage)."""
    tune_session(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _SIGNATURES:
        _SIGNATURES[key] = source_signature(spark, sf_dir)
    built = (key[0], _SIGNATURES[key])
    if built not in _BUILT:
        path = scratch_path(spark, f"warehouse-{built[1]}-{uuid.uuid4().hex}")
        write_warehouse(testbed_load(spark, sf_dir), path)
        _BUILT[built] = path
    return read_warehouse(spark, _BUILT[built])


_SIGNATURES: dict[tuple[str, str], str] = {}
