"""A subset of registered queries against their DuckDB oracle SQL at sf0.001
(tools/oracle_check.py runs all of them)."""

import math

import duckdb
import pytest

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
KEYS = ["dim_time_build", "fact_projection", "fact_table", "star_lookup", "delay_by_airline", "top_routes",
        "live_flatten", "weather_nearest_hour", "delay_rates",
        "route_lookup", "feature_flags", "delay_rates_leakfree", "dim_insert_if_absent"]


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[key])
    d_names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_names)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), d_names)


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
