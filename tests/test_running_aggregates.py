"""Running live aggregates in streaming state equal the batch aggregation, also after a restart."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _land(pages, folder, files):
    pages.repartition(files).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema("page bigint, payload string").option("maxFilesPerTrigger", 2).parquet(folder)


def _batch(pages):
    """Counts and sums by plain aggregation of every accepted record."""
    from skyledger.streaming.running_aggregates import role_rows
    out = {}
    for r in role_rows(pages).collect():
        n = out.setdefault(r.airport_code, [0, 0, 0, 0, 0, 0])
        k = 0 if r.departing else 1
        n[k] += 1
        n[2 + k] += r.minutes > 15
        n[4 + k] += r.minutes
    return {c: (n[0] or None, n[1] or None, n[2] if n[0] else None, n[3] if n[1] else None,
                n[4] / n[0] if n[0] else None, n[5] / n[1] if n[1] else None) for c, n in out.items()}


def _rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_running_aggregates_equal_the_batch_after_several_batches_and_a_restart(spark, tmp_dir):
    from skyledger.sources import testbed
    from skyledger.streaming.running_aggregates import read_running_aggregates, run_running_aggregates
    landing, out, state = (os.path.join(tmp_dir, x) for x in ("landing", "out", "state"))
    assert read_running_aggregates(spark, out).collect() == []
    pages = testbed.live_pages(spark, SF_SMALL)
    first, rest = pages.where(F.col("page") % 3 != 0), pages.where(F.col("page") % 3 == 0)
    broken = spark.createDataFrame([(-1, "no json"), (-2, None), (-3, '{"data": []}')], "page bigint, payload string")
    _land(first.unionByName(broken), landing, 4)
    assert len(run_running_aggregates(_stream(spark, landing), out, state).recentProgress) >= 2
    assert _rows(read_running_aggregates(spark, out)) == _batch(first)
    # a new query with the same checkpoint goes on with the state; nothing new changes nothing
    run_running_aggregates(_stream(spark, landing), out, state)
    assert _rows(read_running_aggregates(spark, out)) == _batch(first)
    _land(rest, landing, 3)
    run_running_aggregates(_stream(spark, landing), out, state)
    assert _rows(read_running_aggregates(spark, out)) == _batch(pages)


def test_a_role_never_seen_is_null_and_totals_add_up():
    import pandas as pd
    from skyledger.streaming.running_aggregates import add_up
    rows = pd.DataFrame({"airport_code": ["A", "A", "B"], "departing": [True, True, False], "minutes": [16, 15, -20]})
    got = {r["airport_code"]: tuple(r[1:]) for _, r in next(iter(add_up([rows.iloc[:0], rows]))).iterrows()}
    assert got == {"A": (2, 1, 31, 0, 0, 0), "B": (0, 0, 0, 1, 0, -20)}
