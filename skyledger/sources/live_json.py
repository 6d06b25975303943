"""Live flight API records: nested JSON -> flat records, page order, row caps, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators.ids import first_rows
from ..session import stored

_S = T.StringType()


def _st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


_ENDPOINT = _st(("iata", _S), ("airport", _S), ("delay", T.DoubleType()), ("scheduled", _S), ("actual", _S))
API_RECORD = _st(("flight_status", _S), ("flight", _st(("iata", _S))),
                 ("airline", _st(("iata", _S), ("name", _S))),
                 ("departure", _ENDPOINT), ("arrival", _ENDPOINT))
API_PAGE = _st(("data", T.ArrayType(API_RECORD)))

FLAT_COLUMNS = [
    "flight_number", "airline_code", "airline_name", "origin_airport_code", "origin_airport_name",
    "destination_airport_code", "destination_airport_name", "live_flight_status",
    "departure_delay_minutes_live", "arrival_delay_minutes_live",
    "scheduled_departure_datetime", "actual_departure_datetime", "scheduled_arrival_datetime",
    "actual_arrival_datetime", "flight_type", "route_category", "route_distance",
]
PAGE_ORDER = ["page", "pos"]


def page_rows(raw: DataFrame) -> DataFrame:
    """Landed files (whole text) as (page, payload).  ``page`` orders the pages as they were pulled:
    the number in the file's name (page-9 before page-10), then its time, then its path."""
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{1,18})", 1)
    return raw.select(F.struct(F.when(number != "", number.cast("bigint")).alias("number"),
                               F.col("_metadata.file_modification_time").alias("landed"), path.alias("path")).alias("page"),
                      F.col("value").alias("payload"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one JSON document per file."""
    return page_rows(spark.read.text(path, wholetext=True))


def page_records(pages: DataFrame) -> DataFrame:
    """Explode ``data`` with its position: (page, pos, rec).  Non-object fields parse as NULL,
    which makes every nested access null-safe.  A page without a readable ``data`` list gives one
    row with NULL pos and record, so that it can be reported; an empty list gives none.

    Empty lists go after the explode: a test of the list before it would be pushed below the parsing, and the page
    written and parsed once more for it."""
    parsed = pages.select("page", F.from_json("payload", API_PAGE).alias("p"))
    lists = parsed.select("page", F.col("p.data").alias("data"), F.col("p.data").isNull().alias("_unread"))
    return (lists.select("page", "_unread", F.posexplode_outer("data").alias("pos", "rec"))
            .where(F.col("pos").isNotNull() | F.col("_unread")).drop("_unread"))


def until_empty_page(pages: DataFrame) -> DataFrame:
    """The pages before the first one, in page order, whose ``data`` list is empty: where a paged
    pull stops.  Only that page's key is looked up (one row)."""
    n = F.size(F.from_json("payload", API_PAGE)["data"])
    stop = pages.where(n == 0).agg(F.min("page").alias("_stop"))
    return (pages.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_stop"))


def normalise(records: DataFrame) -> DataFrame:
    """Nested record -> the 17 flat fields plus ``_keep`` (all four codes present and non-blank).

    Names default to their code, delays to 0, flight type / route category to 'Unknown'."""
    r = "rec"
    fn, al = blank_to_null(F.col(f"{r}.flight.iata")), blank_to_null(F.col(f"{r}.airline.iata"))
    org, dst = blank_to_null(F.col(f"{r}.departure.iata")), blank_to_null(F.col(f"{r}.arrival.iata"))
    keep = fn.isNotNull() & al.isNotNull() & org.isNotNull() & dst.isNotNull()
    return records.select(
        *[c for c in PAGE_ORDER if c in records.columns],
        F.col(f"{r}.flight.iata").alias("flight_number"),
        F.col(f"{r}.airline.iata").alias("airline_code"),
        F.coalesce(blank_to_null(F.col(f"{r}.airline.name")), F.col(f"{r}.airline.iata")).alias("airline_name"),
        F.col(f"{r}.departure.iata").alias("origin_airport_code"),
        F.coalesce(blank_to_null(F.col(f"{r}.departure.airport")), F.col(f"{r}.departure.iata")).alias("origin_airport_name"),
        F.col(f"{r}.arrival.iata").alias("destination_airport_code"),
        F.coalesce(blank_to_null(F.col(f"{r}.arrival.airport")), F.col(f"{r}.arrival.iata")).alias("destination_airport_name"),
        F.col(f"{r}.flight_status").alias("live_flight_status"),
        F.coalesce(F.col(f"{r}.departure.delay").cast("int"), F.lit(0)).alias("departure_delay_minutes_live"),
        F.coalesce(F.col(f"{r}.arrival.delay").cast("int"), F.lit(0)).alias("arrival_delay_minutes_live"),
        F.col(f"{r}.departure.scheduled").alias("scheduled_departure_datetime"),
        F.col(f"{r}.departure.actual").alias("actual_departure_datetime"),
        F.col(f"{r}.arrival.scheduled").alias("scheduled_arrival_datetime"),
        F.col(f"{r}.arrival.actual").alias("actual_arrival_datetime"),
        F.lit("Unknown").alias("flight_type"),
        F.lit("Unknown").alias("route_category"),
        F.lit(None).cast("double").alias("route_distance"),
        keep.alias("_keep"),
    )


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Kept flat records of every page, with (page, pos) order columns."""
    return normalise(page_records(pages)).where("_keep").drop("_keep")


def cap_kept(flat: DataFrame, max_rows: int | None) -> DataFrame:
    """First ``max_rows`` kept records in (page, pos) order — what a paged pull that stops at
    ``max_rows`` kept rows returns; ``None`` keeps everything.  The records are stored: pages are parsed once."""
    return flat if max_rows is None else first_rows(stored(flat, "records"), max_rows, PAGE_ORDER)
