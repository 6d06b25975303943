"""Operator properties: keep-first/last, ids, insert-if-absent, upsert idempotence, rejects."""

from pyspark.sql import functions as F

from skyledger.operators import dims as D
from skyledger.operators.dedupe import keep_first, keep_last
from skyledger.operators.ids import assign_sequential_ids
from skyledger.schemas import empty_table


def test_keep_first_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("a", 0, None)], "k string, o int, v string")
    first = {r.k: r.v for r in keep_first(df, ["k"], ["o"]).collect()}
    last = {r.k: r.v for r in keep_last(df, ["k"], ["o"]).collect()}
    assert first == {"a": None, "b": "z"} and last == {"a": "y", "b": "z"}


def test_sequential_ids(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    for frame in (df, df.repartition(13), df.coalesce(1)):
        assert {r.k: r.n for r in assign_sequential_ids(frame, ["k"], "n", start=10).collect()} == {k: k + 11 for k in range(5000)}
    assert assign_sequential_ids(df.limit(0), ["k"], "n").count() == 0


def test_counters_count_every_source_row(spark):
    """Three rows of one new key, two of an existing one: 1 insert, 4 updates, and the sum is 5."""
    from skyledger.operators.merge import run_counters, upsert_fact
    fields = ("flight_id int, date_id int, scheduled_departure_time_id int, origin_airport_id int, destination_airport_id int, airline_id int, "
              "aircraft_id int, flight_month int, actual_departure_time_id int, weather_condition_id int, delay_cause_id int, delay_minutes int, is_delayed boolean, o int")
    row = lambda flight, delay, o: (flight, 1, 1, 1, 2, 1, 1, 202401, None, 1, 1, delay, delay > 15, o)
    ts = F.lit("2024-01-01").cast("timestamp_ntz")
    first = upsert_fact(empty_table(spark, "fact_flightperformance"), spark.createDataFrame([row(7, 1, 0)], fields), ["o"], ts, target_is_empty=True).affected
    batch = spark.createDataFrame([row(8, 3, 2), row(8, 20, 4), row(8, 5, 3), row(7, 9, 1), row(7, 30, 5)], fields)
    merge = upsert_fact(first, batch, ["o"], ts)
    after, statuses = merge.affected, merge.statuses
    assert {r.flight_id: (r.flight_performance_id, r.delay_minutes) for r in after.collect()} == {7: (1, 30), 8: (2, 20)}
    assert {r.status: r.rows for r in run_counters(statuses, batch.limit(0)).collect()} == {"inserted": 1, "updated": 4, "skipped": 0}


def test_insert_if_absent_keeps_existing_ids(spark):
    target = D.insert_if_absent(empty_table(spark, "dim_flight"),
                                spark.createDataFrame([("B",), ("A",)], "flight_number string"), "dim_flight",
                                target_is_empty=True)
    grown = D.insert_if_absent(target, spark.createDataFrame([("C",), ("A",), (None,)], "flight_number string"),
                               "dim_flight")
    assert {r.flight_number: r.flight_id for r in grown.collect()} == {"A": 1, "B": 2, "C": 3}


def test_upsert_names_refresh(spark):
    target = spark.createDataFrame([(1, "AA", "Old")], "airline_id int, airline_code string, airline_name string")
    batch = spark.createDataFrame([("AA", "New", 1), ("AA", None, 2), ("BB", None, 3)],
                                  "airline_code string, airline_name string, o int")
    out = {r.airline_code: (r.airline_id, r.airline_name)
           for r in D.upsert_names(target, batch, "dim_airline", "airline_name", ["o"]).collect()}
    assert out == {"AA": (1, "New"), "BB": (2, "BB")}


def test_historical_load_conserves_rows(spark):
    from tests.conftest import SF_SMALL
    from skyledger.plans.warehouse import testbed_load
    r = testbed_load(spark, SF_SMALL)
    staged = r.staged.count()
    resolved_keys = r.tables["fact_flightperformance"].count()
    assert sum(x.rows for x in r.counters().collect()) == staged
    # every staged row is either resolved (possibly collapsing onto a key) or quarantined
    from skyledger.operators.resolve import resolve_keys
    resolved, unresolved = resolve_keys(r.staged, r.tables)
    assert resolved.count() + unresolved.count() == staged
    assert resolved_keys == resolved.select("flight_id", "date_id", "scheduled_departure_time_id",
                                            "origin_airport_id", "destination_airport_id").distinct().count()


def test_live_upsert_is_idempotent(spark):
    from tests.conftest import SF_SMALL
    from skyledger.plans.live_update import upsert_live
    from skyledger.plans.warehouse import warehouse_for
    from skyledger.sources import testbed
    wh = warehouse_for(spark, SF_SMALL)
    pages = testbed.live_pages(spark, SF_SMALL)
    once = upsert_live(spark, wh, pages).tables
    twice = upsert_live(spark, once, pages).tables
    cols = ["flight_performance_id", "flight_id", "date_id", "delay_minutes", "is_delayed", "actual_departure_time_id"]
    a = once["fact_flightperformance"].select(*cols)
    b = twice["fact_flightperformance"].select(*cols)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_pruned_star_matches_full_star(spark):
    """Joining only the dimension roles a query reads gives the same rows as the full star."""
    from skyledger.operators.analytics import DASHBOARD_STAR_COLUMNS
    from skyledger.operators.star import star_lookup
    from skyledger.plans.warehouse import warehouse_for
    from tests.conftest import SF_SMALL
    wh = warehouse_for(spark, SF_SMALL)
    full = star_lookup(wh).select(*DASHBOARD_STAR_COLUMNS)
    lean = star_lookup(wh, DASHBOARD_STAR_COLUMNS)
    assert lean.count() == full.count()
    assert lean.exceptAll(full).count() == 0 and full.exceptAll(lean).count() == 0
    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(lean) == 5 and joins(full) == 9   # date, time, two airport roles, airline


def test_constraint_report_finds_orphans_and_duplicates(spark):
    """Injected violations: one orphan airline id, one NULL FK (not an orphan), one duplicate fact key."""
    from skyledger.operators.quality import constraint_report
    from skyledger.plans.warehouse import warehouse_for
    from tests.conftest import SF_SMALL
    wh = dict(warehouse_for(spark, SF_SMALL))
    clean = {(r.table_name, r.check_name): r.violations for r in constraint_report(wh).collect()}
    assert all(v == 0 for v in clean.values())        # FK closure and key uniqueness after the load
    fact = wh["fact_flightperformance"]
    one = fact.limit(1)
    wh["fact_flightperformance"] = (fact.unionByName(one)
                                    .unionByName(one.withColumn("airline_id", F.lit(999999)))
                                    .unionByName(one.withColumn("actual_departure_time_id", F.lit(None).cast("int"))))
    al = wh["dim_airline"]
    first = al.orderBy("airline_id").limit(1)
    wh["dim_airline"] = (al.unionByName(first.withColumn("airline_id", F.lit(777)))       # duplicate code
                         .unionByName(first.withColumn("airline_code", F.lit(None).cast("string")))  # NULL code, dup id
                         .unionByName(first.withColumns({"airline_id": F.lit(778),
                                                         "airline_code": F.lit(None).cast("string")})))
    got = {(r.table_name, r.check_name): r.violations for r in constraint_report(wh).collect()}
    assert len(got) == 3 * 8 + 1 + 10
    assert got[("fact_flightperformance", "orphan airline_id")] == 1
    assert got[("fact_flightperformance", "orphan actual_departure_time_id")] == 0
    assert got[("fact_flightperformance", "duplicate natural key")] == 1
    assert got[("dim_airline", "duplicate airline_code")] == 1
    assert got[("dim_airline", "null airline_code")] == 2
    assert got[("dim_airline", "duplicate airline_id")] == 1
    assert got[("dim_airport", "duplicate airport_code")] == 0 and got[("dim_date", "null full_date")] == 0
