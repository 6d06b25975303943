"""Raw file and live page sources: columns by name, encodings, order, rejects."""

import json
import os

import pytest
from pyspark.sql import types as T


def _write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_csv_is_read_by_name(spark, tmp_dir):
    from skyledger.sources.files import RAW_AIRPORTS, RAW_FLIGHTS, extract_raw, read_csv
    _write(tmp_dir, "flights.csv", "EXTRA,DAY,MONTH,YEAR,FLIGHT_NUMBER,AIRLINE,ORIGIN_AIRPORT,DESTINATION_AIRPORT,SCHEDULED_DEPARTURE,DEPARTURE_TIME\n"
           "x,2,1,2015,98,AA,ANC,SEA,5,2354.0\nx,bad,1,2015,99,AA,ANC,SEA,,\n")
    _write(tmp_dir, "airlines.csv", "IATA_CODE,AIRLINE\nF9,Frontier\n")
    _write(tmp_dir, "airports.csv", "AIRPORT,IATA_CODE,CITY,COUNTRY,LATITUDE,LONGITUDE\nSan Jos\u00e9\u00a0(Main),SJC,San Jose,USA,37.3,\n")
    raw = extract_raw(spark, tmp_dir)
    rows = raw["flights"].orderBy("flight_number").collect()
    assert raw["flights"].columns[:10] == RAW_FLIGHTS.names and "extra" not in raw["flights"].columns
    assert (rows[0].day, rows[0].scheduled_departure, rows[0].departure_time, rows[0].departure_delay) == (2, 5.0, 2354.0, None)
    assert rows[1].day is None and rows[1].flight_number == "99"
    airport = raw["airports"].first()
    assert raw["airports"].columns[:7] == RAW_AIRPORTS.names and airport.state is None and airport.airport == "San Jos\u00e9\u00a0(Main)" and airport.longitude is None
    _write(tmp_dir, "short.csv", "YEAR\n2015\n")
    with pytest.raises(ValueError, match="month"):
        read_csv(spark, os.path.join(tmp_dir, "short.csv"), RAW_FLIGHTS, required=["year", "month"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, os.path.join(tmp_dir, "absent.csv"))


def test_csv_falls_back_to_latin1(spark, tmp_dir):
    from skyledger.sources.files import read_csv_any_encoding
    schema = T.StructType([T.StructField("city", T.StringType())])
    latin = _write(tmp_dir, "latin.csv", "CITY\nMalm\u00f6\n", "latin-1")
    utf8 = _write(tmp_dir, "utf8.csv", "CITY\nMalm\u00f6\n")
    assert [read_csv_any_encoding(spark, p, schema).first().city for p in (latin, utf8)] == ["Malm\u00f6"] * 2


def test_append_and_preview(spark, tmp_dir):
    from skyledger.schemas import TABLES
    from skyledger.sources.files import append_to_table, table_preview
    path = os.path.join(tmp_dir, "dim_airline")
    for code in ("AA", "AA"):
        append_to_table(spark.createDataFrame([(1, code)], "airline_id int, airline_code string"), TABLES["dim_airline"], path)
    table = spark.read.parquet(path)
    assert table.count() == 2 and table.columns == TABLES["dim_airline"].names
    assert table_preview({"dim_airline": table}, "dim_airline", "airline_id").count() == 2
    with pytest.raises(ValueError):
        table_preview({"dim_airline": table}, "users", "id")


def _record(flight, delay=None, scheduled="2024-01-02T10:00:00Z"):
    end = {"iata": "AAA", "airport": None, "delay": delay, "scheduled": scheduled, "actual": None}
    return {"flight_status": "active", "flight": {"iata": flight}, "airline": {"iata": "XX", "name": None}, "departure": end, "arrival": end | {"iata": "BBB"}}


def test_pages_in_pull_order_without_losses(spark, tmp_dir):
    from skyledger.plans.live_update import parse_batch
    from skyledger.sources.live_json import cap_kept, flatten_pages, read_pages, until_empty_page
    for n, flights in ((9, ["XX9"]), (10, ["XX10", ""]), (11, []), (12, ["XX12"])):
        _write(tmp_dir, f"page-{n}.json", json.dumps({"data": [_record(f, 12.5) for f in flights]}))
    _write(tmp_dir, "page-13.json", '{"data": [{"flight": ')
    pages = read_pages(spark, tmp_dir)
    assert cap_kept(flatten_pages(pages), 1).first().flight_number == "XX9"
    assert {r.flight_number for r in flatten_pages(until_empty_page(pages)).collect()} == {"XX9", "XX10"}
    batch = parse_batch(pages)
    assert {r.flight_number: r.delay_minutes for r in batch.accepted.collect()} == {"XX9": 12, "XX10": 12, "XX12": 12}
    assert sorted((r.reason, r.page.number) for r in batch.rejected.collect()) == [("missing flight, airline or airport code", 10), ("unreadable page", 13)]
