"""Every registered query with SQL, against DuckDB at the smallest scale, and table invariants."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from stopwise.plans import catalogue  # noqa: E402
from stopwise.plans.lake import lake  # noqa: E402
from tools.check import TABLES, rows_of, same  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(same(a, b) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_invariants(spark):
    k = lake(spark, SF)
    stops, routes = k.get("stops").count(), k.get("routes").count()
    seg = k.get("gold_segments")
    assert seg.count() == stops - routes
    assert seg.filter("segment_position = 1 AND cumulative_distance_km <> 0").isEmpty()
    folds = k.get("folds")
    assert folds.count() == k.get("train").select("route_id").distinct().count()
    p = k.get("proposals")
    assert p.count() == k.get("planned_routes").count()
    assert p.groupBy("route_id", "proposed_position").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
