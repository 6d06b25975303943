"""What the load moves: lines move once, rows are numbered from stored columns, and keys that come once are not folded."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_warehouse_commits import _rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_tasks_read_little_enough_to_sort(spark):
    from skyledger.session import SCAN_BYTES, tune_session
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for given, want in ((str(128 << 20), str(SCAN_BYTES)), (str(1 << 20), str(1 << 20))):
        spark.conf.set("spark.sql.files.maxPartitionBytes", given)
        assert tune_session(spark).conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_lines_are_not_moved_by_customer(spark):
    """The customer's nation comes with the order; a shuffled customer never moves the lines."""
    from skyledger.sources.testbed import flights_raw
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(flights_raw(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(o_custkey" in line or "Exchange hashpartitioning(l_" in line]
    assert len([m for m in moved if "o_custkey" in m]) == 1 and len([m for m in moved if "l_orderkey" in m]) == 1


def test_sequential_ids_are_stored_and_may_drop_their_order(spark):
    from skyledger.operators.ids import assign_sequential_ids
    checkpoints = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(checkpoints))
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("k"), F.col("id").alias("v"))
    out = assign_sequential_ids(df, ["k"], "n", start=5, keep_order=False)
    assert out.columns == ["v", "n"] and {r.v: r.n for r in out.collect()} == {v: v * 7 % 3000 + 6 for v in range(3000)}
    assert not [f for f in set(os.listdir(checkpoints)) - before if f.startswith("rdd-")]


def test_keys_that_come_once_are_not_folded(spark):
    from skyledger.operators.merge import collapse_source
    rows = _rows(spark, [*range(200), 3, 3, 7]).withColumn("delay_minutes", F.col("o"))
    out = collapse_source(rows, ["o"])
    assert "LeftAnti" in _plan(out)
    got = {r.flight_id: (r._first_at.o, r._last.delay_minutes, r._rows) for r in out.collect()}
    want = {f: (f, f, 1) for f in range(200)} | {3: (3, 201, 3), 7: (7, 202, 2)}
    assert got == want


def test_an_upsert_joins_matched_keys_alone_and_numbers_new_rows_as_they_are(spark, tmp_dir):
    """Mixed batch on a scanned target: updates, inserts with ids in file order, rows of the file left unchanged."""
    from skyledger.operators.merge import upsert_fact
    from skyledger.plans.warehouse import run_timestamp
    from skyledger.schemas import empty_table
    first = upsert_fact(empty_table(spark, "fact_flightperformance"), _rows(spark, range(20)), ["o"], run_timestamp(), target_is_empty=True).affected
    first.coalesce(1).write.parquet(f"{tmp_dir}/fact")
    target = spark.read.schema(first.schema).parquet(f"{tmp_dir}/fact")
    merge = upsert_fact(target, _rows(spark, [30, 5, 29, 30], delay=20), ["o"], run_timestamp())
    assert "FullOuter" not in _plan(merge.affected)
    got = {r.flight_id: (r.flight_performance_id, r.delay_minutes, r._status, r._rows) for r in merge.merged.collect()}
    assert len(got) == 22 and got[30] == (21, 20, "inserted", 2) and got[29] == (22, 20, "inserted", 1)
    assert got[5] == (6, 20, "updated", 1) and got[6] == (7, 0, "unchanged", 0)


def test_blank_is_what_stripping_leaves_empty(spark):
    from skyledger.functions.text import blank_to_null, strip_blanks
    texts = ["", " ", "\t\n", "  ", "\x1c\x1f\x85", "a", " a ", " x", "​", "0", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", blank_to_null("t").alias("got"), strip_blanks("t").alias("s")).collect()
    assert all(r.got == (r.t if r.s else None) for r in rows)
    assert "regexp_replace" not in str(blank_to_null("t"))


def test_candidates_are_fitted_side_by_side(spark):
    """Two fits that wait for each other end: one after the other they would not."""
    import threading
    from skyledger.ml.training import fit_all
    both = threading.Barrier(2)

    class Fit:
        def __init__(self, name):
            self.name = name

        def fit(self, train):
            both.wait(30)
            return self.name, train.count()

    got = fit_all(spark, {"b": Fit("b"), "a": Fit("a")}, spark.range(3))
    assert list(got.items()) == [("b", ("b", 3)), ("a", ("a", 3))]
