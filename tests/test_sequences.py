"""Routes that do not fit in one chunk."""

import types

from pyspark.sql import functions as F

from stopwise.operators import sequences
from stopwise.plans import catalogue

catalogue.load_all()


def test_long_route_is_one_row(spark, monkeypatch):
    n = 9000
    df = spark.range(1, n + 1).repartition(5).select(
        F.lit("r").alias("route_id"),
        F.lit("s").alias("station_code"),
        F.col("id").cast("int").alias("segment_position"),
        F.col("id").cast("double").alias("segment_distance_km"),
        F.lit(1).alias("packages_at_destination"),
        (F.col("id") * 60).cast("double").alias("travel_time_seconds"),
        (F.col("id") == 1).cast("int").alias("is_depot_segment"),
    )
    monkeypatch.setattr(catalogue, "lake", lambda *_: types.SimpleNamespace(get=lambda name: df), raising=False)
    rows = catalogue.QUERIES["route_sequences"](spark, "").collect()
    assert len(rows) == 1 and rows[0].length == n
    assert rows[0].x == [v for i in range(1, n + 1) for v in (float(i), 1.0)]
    assert rows[0].y == [float(i) for i in range(1, n + 1)]
    assert rows[0].population == [1] + [0] * (n - 1)


def test_short_routes_move_once(spark):
    df = spark.createDataFrame(
        [(f"r{i % 4}" if i % 5 else None, "s", i, 1.0 * i, 60.0 * i, int(i < 4)) for i in range(20)],
        "route_id string, station_code string, segment_position int, km double, travel_time_seconds double, is_depot_segment int",
    )
    out = sequences.whole_routes(sequences.route_sequences(df, ["km"]))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    far = df.withColumn("segment_position", F.col("segment_position") + 4096)
    want = sequences.whole_routes(sequences.route_sequences(far, ["km"]))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
