"""Raw-file sources: schema'd CSV scans, file-order ordinals, row caps, encoding fallback,
appends and table previews."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ids import first_rows
from ..schemas import conform, lower_case_columns, require_columns

# Columns that carry "file order" through a distributed plan.
ORDINAL_COLUMNS = ["_src_file", "_src_block", "_src_pos"]

# Tables a preview may show, and the preview size (reference rules).
PREVIEW_TABLES = ("fact_flightperformance", "dim_airline", "dim_airport", "dim_date", "dim_time",
                  "dim_flight", "dim_aircraft", "dim_weather_condition", "dim_delay_cause")
PREVIEW_ROWS = 100

RAW_FLIGHTS = T.StructType([T.StructField(n, t, True) for n, t in [
    ("year", T.IntegerType()), ("month", T.IntegerType()), ("day", T.IntegerType()),
    ("airline", T.StringType()), ("flight_number", T.StringType()),
    ("origin_airport", T.StringType()), ("destination_airport", T.StringType()),
    ("scheduled_departure", T.DoubleType()), ("departure_time", T.DoubleType()),
    ("departure_delay", T.DoubleType()),
]])
RAW_AIRLINES = T.StructType([T.StructField("iata_code", T.StringType()),
                             T.StructField("airline", T.StringType())])
RAW_AIRPORTS = T.StructType([T.StructField(n, t, True) for n, t in [
    ("iata_code", T.StringType()), ("airport", T.StringType()), ("city", T.StringType()),
    ("state", T.StringType()), ("country", T.StringType()), ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
]])


def with_file_ordinal(df: DataFrame) -> DataFrame:
    """Attach (file, split start, position in split) — a total order equal to file order.

    Must be applied directly on a file scan, before any shuffle.
    """
    return df.select("*",
                     F.col("_metadata.file_path").alias("_src_file"),
                     F.col("_metadata.file_block_start").alias("_src_block"),
                     F.monotonically_increasing_id().alias("_src_pos"))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
             encoding: str = "UTF-8", ordinal: bool = True, required: list[str] | None = None) -> DataFrame:
    """Header CSV read by column name (case doesn't matter): every column comes in as text, the
    schema's columns are picked and cast, absent ones are NULL, others are left out.  Without a
    schema all columns stay text.  Absent ``required`` columns are an error.

    A missing path raises Spark's PATH_NOT_FOUND error, as a missing file must.
    """
    df = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
          .option("inferSchema", False).csv(path))
    if ordinal:
        df = with_file_ordinal(df)
    df = lower_case_columns(df.toDF(*[c.removeprefix("\ufeff") for c in df.columns]))
    require_columns(df, required or [], str(path))
    if schema is None:
        return df
    cast = lambda f: (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
    return df.select(*[cast(f) for f in schema.fields], *(ORDINAL_COLUMNS if ordinal else []))


def extract_raw(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """The three raw inputs of a historical load: flights, airlines, airports."""
    keys = {"flights": ["year", "month", "day", "airline", "flight_number", "origin_airport", "destination_airport"],
            "airlines": ["iata_code", "airline"], "airports": ["iata_code", "airport"]}
    schemas = {"flights": RAW_FLIGHTS, "airlines": RAW_AIRLINES, "airports": RAW_AIRPORTS}
    return {n: read_csv(spark, f"{raw_dir}/{n}.csv", schemas[n], required=keys[n]) for n in schemas}


def files_by_encoding(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """(files that are valid UTF-8, the others).  Lines come in as raw bytes and are checked where they are read,
    so large files are checked in parallel; one row a file reaches the driver."""
    lines = spark.read.text(path)
    files = (lines.groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.bool_and(F.is_valid_utf8("value")).alias("valid")).orderBy("file").collect())
    named = [(unquote(r["file"]), r["valid"]) for r in files]
    return [f for f, ok in named if ok], [f for f, ok in named if not ok]


def read_csv_any_encoding(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Each file as UTF-8 (with or without a byte order mark) if its bytes are valid UTF-8, else as Latin-1: a union
    of two scans.  A U+FFFD that a UTF-8 file really holds stays.  Columns are matched by name."""
    utf8, other = files_by_encoding(spark, path)
    scans = [read_csv(spark, files, schema, encoding=encoding, ordinal=False)
             for files, encoding in ((utf8, "UTF-8"), (other, "ISO-8859-1")) if files]
    if not scans:                          # no line at all: a missing path is an error, an empty file has no columns
        return read_csv(spark, path, schema, ordinal=False)
    return scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1], allowMissingColumns=True)


def cap_rows(df: DataFrame, n: int | None, order_cols: list[str]) -> DataFrame:
    """Keep the first ``n`` rows in file order (``n=None`` keeps everything)."""
    return df if n is None else first_rows(df, n, order_cols)


def append_to_table(df: DataFrame, schema: T.StructType, path: str, partition_by: list[str] | None = None) -> None:
    """Bulk append an uploaded frame to a table: schema conformed, no de-duplication."""
    writer = conform(df, schema).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def table_preview(tables: dict[str, DataFrame], name: str, order_by: str) -> DataFrame:
    """First PREVIEW_ROWS rows of an allow-listed table, in key order so the preview is stable."""
    if name not in PREVIEW_TABLES or name not in tables:
        raise ValueError(f"Table is not available for preview: {name}")
    return tables[name].orderBy(order_by).limit(PREVIEW_ROWS)
