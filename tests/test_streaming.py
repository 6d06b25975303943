"""The streaming live update commits the same warehouse as the batch live update."""

import os

from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_dir):
    from skyledger.plans.live_update import upsert_live
    from skyledger.plans.warehouse import read_warehouse, testbed_load, write_warehouse
    from skyledger.sources import testbed
    from skyledger.streaming.live_stream import run_live_stream

    wh_dir = os.path.join(tmp_dir, "warehouse")
    write_warehouse(testbed_load(spark, SF_SMALL), wh_dir)

    # land the pages as files (several per file-batch) for the stream to pick up
    landing = os.path.join(tmp_dir, "landing")
    pages = testbed.live_pages(spark, SF_SMALL)
    rows = pages.orderBy("page").collect()
    os.makedirs(landing)
    for r in rows:
        with open(os.path.join(landing, f"page-{r['page']}.json"), "w") as fh:
            fh.write(r["payload"])

    _, log = run_live_stream(spark, landing, wh_dir, os.path.join(tmp_dir, "stream-ckpt"))
    assert log, "the stream committed no batch"
    streamed = read_warehouse(spark, wh_dir)["fact_flightperformance"]

    # batch reference: same page files read in one go
    from skyledger.sources.live_json import read_pages
    batch_pages = read_pages(spark, landing)
    wh2 = os.path.join(tmp_dir, "warehouse2")
    write_warehouse(testbed_load(spark, SF_SMALL), wh2)
    expected = upsert_live(spark, read_warehouse(spark, wh2), batch_pages).tables["fact_flightperformance"]

    cols = ["flight_id", "date_id", "scheduled_departure_time_id", "origin_airport_id", "destination_airport_id",
            "delay_minutes", "is_delayed"]
    a, b = streamed.select(*cols), expected.select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_crash_before_the_manifest_changes_nothing_and_replays_count_once(spark, tmp_dir, monkeypatch):
    """A commit that dies between its tables and its manifest leaves the old version in force."""
    import json
    import pytest
    from skyledger.plans import warehouse
    from skyledger.sources import testbed
    from skyledger.streaming.live_stream import commit_batch

    path = os.path.join(tmp_dir, "warehouse")
    warehouse.write_warehouse(warehouse.testbed_load(spark, SF_SMALL), path)
    before = {n: t.count() for n, t in warehouse.read_warehouse(spark, path).items()}
    pages = testbed.live_pages(spark, SF_SMALL)
    held = set(spark.sparkContext._jsc.getPersistentRDDs())      # by other tests of the session

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(warehouse, "manifest_text", fail)
        with pytest.raises(OSError):
            commit_batch(spark, pages, path, batch_id=1)
    assert {n: t.count() for n, t in warehouse.read_warehouse(spark, path).items()} == before
    commit_batch(spark, pages, path, batch_id=1)
    after = {n: t.count() for n, t in warehouse.read_warehouse(spark, path).items()}
    assert after["fact_flightperformance"] > before["fact_flightperformance"] and after["dim_time"] > before["dim_time"]
    commit_batch(spark, pages, path, batch_id=1)
    manifest = warehouse.read_manifest(spark, path)
    assert manifest["version"] == 2 and manifest["batch_id"] == 1 and json.dumps(manifest)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
