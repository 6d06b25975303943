"""Live pages: each is written and parsed once, and a record's clocks are computed once."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _pages(spark, path):
    pages = [(1, '{"data": [{"flight_status": "a"}, null]}'), (2, '{"data": []}'), (3, "no json"), (4, None), (5, "{}")]
    spark.createDataFrame(pages, "page long, payload string").write.parquet(path)
    return spark.read.parquet(path)


def test_a_page_is_parsed_once(spark, tmp_dir):
    from skyledger.sources.live_json import page_records
    spark.conf.set("spark.sql.maxPlanStringLength", "400000")
    pages = _pages(spark, f"{tmp_dir}/pages").select("page", F.concat("payload", F.lit(" ")).alias("payload"))
    records = page_records(pages)
    assert _plan(records).count("from_json(") == 1 and _plan(records).count("concat(") == 1
    got = sorted((r.page, r.pos, r.rec.flight_status if r.rec else None) for r in records.where("pos is not null").collect())
    assert got == [(1, 0, "a"), (1, 1, None)]
    assert sorted(r.page for r in records.where("pos is null").collect()) == [3, 4, 5]


def test_a_capped_pull_reads_stored_records(spark, tmp_dir):
    from skyledger.sources.live_json import cap_kept, page_records
    capped = cap_kept(page_records(_pages(spark, f"{tmp_dir}/pages")).where("pos is not null"), 1)
    assert "from_json(" not in _plan(capped)
    assert [(r.page, r.pos) for r in capped.collect()] == [(1, 0)]


def test_a_records_clocks_are_computed_once(spark):
    """Two clocks of two padded parts each."""
    from skyledger.sources.testbed import live_pages
    spark.conf.set("spark.sql.maxPlanStringLength", "400000")
    assert _plan(live_pages(spark, SF_SMALL)).count("lpad(") == 4
