"""Large tables are dealt to a held number of tasks, and in waves of keys above that."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stopwise.operators import ordered
from stopwise.plans import fixtures


def partitions(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_are_not_joined_by_spark(spark, monkeypatch):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ordered, "DEALT_ROWS", 20_000 // (2 * cores))
    assert ordered.dealt(df, "k", [df]).rdd.getNumPartitions() >= 2 * cores
    assert "REPARTITION_BY_NUM" in partitions(ordered.dealt(df, "k", [df]))


def test_writing_tasks_stream_while_reading_tasks_can_sort_more(monkeypatch):
    monkeypatch.setattr(ordered, "DEALT_ROWS", 10)
    monkeypatch.setattr(ordered, "MOST_ROWS", 100)
    assert [ordered.dealt_tasks(n) for n in (5, 1_000, 2_000, 2_010, 20_000, 20_001)] == [1, 100, 200, 200, 200, 201]


def test_waves_hold_every_row(spark, monkeypatch):
    rows = [(None if i % 7 == 0 else f"R{i % 5}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "route_id string, n int")
    w = Window.partitionBy("route_id").orderBy("n")

    def plan(left, right):
        size = right.groupBy("route_id").agg(F.sum("n").alias("s"))
        return left.withColumn("r", F.row_number().over(w)).join(size, "route_id", "left")

    want = sorted(map(str, ordered.in_waves(plan, "route_id", df, df).collect()))
    monkeypatch.setattr(ordered, "MOST_FILES", 1)
    monkeypatch.setattr(ordered, "MOST_ROWS", 30)
    assert "Union" in partitions(ordered.in_waves(plan, "route_id", df, df))
    assert sorted(map(str, ordered.in_waves(plan, "route_id", df, df).collect())) == want and len(want) == 50


def test_stops_of_routes_are_counted_where_they_meet(spark):
    stops = spark.createDataFrame(
        [(i % 3 or None, "Station" if i < 3 else "Dropoff", 40.0 + i, -70.0, i) for i in range(9)],
        "rk long, stop_type string, lat double, lng double, position int",
    )
    routes = spark.createDataFrame(
        [(1, "R1"), (2, "R2"), (2, "R2"), (4, "R4"), (None, None)], "rk long, route_id string"
    ).selectExpr("*", "'A' AS station_code", "DATE '2024-01-01' AS route_date", "'08:00:00' AS departure_time_utc",
                 "1.0D AS executor_capacity_cm3", "'High' AS route_score")
    out = fixtures.silver_routes(routes, stops)
    assert sorted((r.route_id or "", r.total_stops, r.station_stops) for r in out.collect()) == [
        ("", None, None), ("R1", 3, 1), ("R2", 3, 1), ("R2", 3, 1), ("R4", None, None)
    ]
    assert "REPARTITION_BY" in partitions(out)
