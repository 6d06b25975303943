"""What a commit writes: files that hold a changed row, dimensions that grew, one manifest."""

import os

import pytest
from pyspark.sql import functions as F

from skyledger.schemas import FACT_KEY, TABLES, empty_table

KEYS = ("flight_id int, date_id int, scheduled_departure_time_id int, origin_airport_id int, destination_airport_id int, airline_id int, "
        "aircraft_id int, flight_month int, actual_departure_time_id int, weather_condition_id int, delay_cause_id int, delay_minutes int, "
        "is_delayed boolean, o int")


def _rows(spark, flights, month=202401, delay=0):
    return spark.createDataFrame([(f, 1, 1, 1, 2, 1, 1, month, None, 1, 1, delay, delay > 15, i) for i, f in enumerate(flights)], KEYS)


def _commit(spark, path, tables, resolved, changed_dims=(), empty=False, batch_id=None):
    from skyledger.operators.merge import upsert_fact
    from skyledger.plans.warehouse import LoadResult, run_timestamp, write_warehouse
    merge = upsert_fact(tables["fact_flightperformance"], resolved, ["o"], run_timestamp(), target_is_empty=empty)
    nothing = spark.createDataFrame([], "reason string")
    manifest = write_warehouse(LoadResult(tables, merge, list(changed_dims), nothing, nothing), path, batch_id)
    return merge, manifest


@pytest.fixture()
def warehouse(spark, tmp_dir):
    """A month of eight files of 50 flights, and a second month."""
    path = os.path.join(tmp_dir, "wh")
    tables = {n: empty_table(spark, n) for n in TABLES}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        rows = _rows(spark, range(400)).unionByName(_rows(spark, range(1000, 1010), month=202402).withColumn("date_id", F.lit(2)))
        _commit(spark, path, tables, rows, empty=True)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    return path


def _files(path, pattern="fact_flightperformance"):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(os.path.join(path, pattern)) for f in fs if f.endswith(".parquet"))


def _content(spark, path):
    from skyledger.plans.warehouse import read_warehouse
    rows = read_warehouse(spark, path)["fact_flightperformance"].select("flight_id", "flight_performance_id", "delay_minutes", "flight_month").collect()
    assert len({r.flight_id for r in rows}) == len(rows) == len({r.flight_performance_id for r in rows})
    return {r.flight_id: (r.flight_performance_id, r.delay_minutes, r.flight_month) for r in rows}


def test_one_changed_row_rewrites_one_file(spark, warehouse):
    from skyledger.plans.warehouse import read_warehouse
    before, files, dims = _content(spark, warehouse), _files(warehouse), _files(warehouse, "dim_date")
    assert len([f for f in files if "202401" in f]) >= 8 and len(before) == 410
    tables = read_warehouse(spark, warehouse)
    merge, manifest = _commit(spark, warehouse, tables, _rows(spark, [123], delay=44))
    assert len(merge.files) == 1 and merge.merged.count() <= 50      # that file's rows alone are merged
    added = sorted(set(_files(warehouse)) - set(files))
    assert len(added) == 1 and "202401" in added[0]
    assert [len(gone) for v in manifest["months"]["202401"].values() for gone in [v]] == [1, 0]
    assert list(manifest["months"]["202402"].values()) == [[]]
    after = _content(spark, warehouse)
    assert after == before | {123: (before[123][0], 44, 202401)}
    assert _files(warehouse, "dim_date") == dims            # no dimension changed, none was written
    # a new key alone touches no file; then a key of the rewritten file and one of the new file change
    merge, _ = _commit(spark, warehouse, read_warehouse(spark, warehouse), _rows(spark, [5000], delay=1))
    assert merge.files == []
    merge, manifest = _commit(spark, warehouse, read_warehouse(spark, warehouse), _rows(spark, [123, 5000, 6000], delay=2))
    assert len(merge.files) == 2
    now = _content(spark, warehouse)
    assert now == before | {123: (before[123][0], 2, 202401), 5000: (411, 2, 202401), 6000: (412, 2, 202401)}


def test_replaced_files_are_not_opened(spark, warehouse):
    from skyledger.plans.warehouse import read_warehouse
    _commit(spark, warehouse, read_warehouse(spark, warehouse), _rows(spark, [7], delay=9))
    fact = read_warehouse(spark, warehouse)["fact_flightperformance"].where("flight_month = 202401")
    assert fact.count() == 400
    used = {r[0].split("/")[-1] for r in fact.select("_metadata.file_path").distinct().collect()}
    on_disk = {f.split("/")[-1] for f in _files(warehouse) if "202401" in f}
    assert len(on_disk - used) == 1
    for name in on_disk - used:          # a replaced file may even be unreadable
        at = next(f for f in _files(warehouse) if f.endswith(name))
        with open(at, "wb") as fh:
            fh.write(b"x")
        crc = os.path.join(os.path.dirname(at), f".{name}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert read_warehouse(spark, warehouse)["fact_flightperformance"].where("flight_month = 202401").agg(F.sum("delay_minutes")).first()[0] == 9


def test_months_outside_the_batch_are_not_read(spark, warehouse):
    from skyledger.plans.warehouse import read_warehouse
    second = next(f for f in _files(warehouse) if "202402" in f)
    with open(second, "wb") as fh:
        fh.write(b"x")
    crc = os.path.join(os.path.dirname(second), f".{os.path.basename(second)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    from skyledger.operators.merge import matched_files, reads_files
    fact = read_warehouse(spark, warehouse)["fact_flightperformance"]
    assert reads_files(fact) and not reads_files(fact.unionByName(fact))
    january = fact.where("flight_month = 202401")
    found = matched_files(january, _rows(spark, [3, 9999]).select(*FACT_KEY)).collect()
    assert {r.flight_id: r._file is not None for r in found} == {3: True, 9999: False}


def test_versions_that_no_manifest_names_go_after_the_grace_period(spark, warehouse):
    from skyledger.plans.warehouse import read_manifest, read_warehouse, remove_old_versions
    grown = read_warehouse(spark, warehouse)
    grown["dim_date"] = grown["dim_date"].unionByName(empty_table(spark, "dim_date"))
    _commit(spark, warehouse, grown, _rows(spark, [1], delay=3), changed_dims=["dim_date"], batch_id=4)
    spark.range(1).write.parquet(f"{warehouse}/dim_time/version=dead")            # a commit that died
    expected = _content(spark, warehouse)
    assert remove_old_versions(spark, warehouse) == []
    gone = remove_old_versions(spark, warehouse, grace_seconds=-5)
    assert sorted(p.split("/")[-2] for p in gone) == ["dim_date", "dim_time", "manifest"]
    assert read_manifest(spark, warehouse)["version"] == 2 and _content(spark, warehouse) == expected
    # an incomplete manifest is passed over; a batch committed before is recognised
    os.makedirs(f"{warehouse}/manifest/{3:012d}")
    assert read_manifest(spark, warehouse)["version"] == 2
    _, manifest = _commit(spark, warehouse, read_warehouse(spark, warehouse), _rows(spark, [1], delay=30), batch_id=4)
    assert manifest["version"] == 2 and _content(spark, warehouse) == expected
