"""Segments meet their stops and packages by route, by route and block, and in plain Python alike."""

from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import splits, stops as st


def tables(spark, first):
    def rid(i):
        return None if i == 3 else f"R{i}"

    # route 3 has no id, a stop has no packages, one has two, one is unknown, one has no id
    legs = [(rid(i), first + p, f"S{p}", None if p == 4 else f"S{p + 1}", 10.0 * p + i) for i in range(5) for p in range(1, 6)]
    stops = [(rid(i), f"S{p}", 40.0 + p, -70.0 - i, "Dropoff", f"Z{p}") for i in range(5) for p in range(1, 6)]
    stops.append(("R0", None, 1.0, 1.0, "Dropoff", "Z9"))
    packages = [(rid(i), f"S{p}", "DELIVERED", p % 2, 30.5 * p, 7.0 * n) for i in range(5) for p in (1, 2, 2, 5) for n in range(p)]
    packages.append(("R0", None, "DELIVERED", 1, 1.0, 1.0))
    segments = spark.createDataFrame(legs, schemas.SEGMENTS)
    stops = spark.createDataFrame(stops, "route_id string, stop_id string, lat double, lng double, stop_type string, zone_id string")
    packages = spark.createDataFrame(
        packages,
        "route_id string, stop_id string, scan_status string, has_time_window int, planned_service_time_seconds double, volume_cm3 double",
    )
    return segments.repartition(3), stops, packages


def ends(spark, first, loads=True):
    segments, stops, packages = tables(spark, first)
    out = st.with_ends(segments, stops, packages if loads else None)
    assert out.columns == [*segments.columns[:2], *segments.columns[2:], "origin", "target"]
    rows = out.withColumn("segment_position", F.col("segment_position") - first).collect()
    return sorted(str(r.asDict(True)) for r in rows if r.route_id is not None), [r for r in rows if r.route_id is None]


def test_one_dealing_and_blocks_agree(spark):
    for loads in (True, False):
        near, lost = ends(spark, 0, loads)
        far, _ = ends(spark, 10_000, loads)
        assert near == far and len(near) == 20
        assert {r.origin for r in lost} == {None} and all(r.target is None or r.target["at"] is None for r in lost)


def test_legs_are_dealt_once(spark, tmp_path):
    for name, df in zip(("segments", "stops", "packages"), tables(spark, 0)):
        df.write.parquet(f"{tmp_path}/{name}")
    read = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("segments", "stops", "packages")]
    plan = st.with_ends(*read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_split_without_a_join(spark):
    df = spark.createDataFrame([(f"R{i}", n) for i in range(50) for n in range(2)] + [(None, 1)], "route_id string, n int")
    split = splits.split_routes(df.where("route_id IS NOT NULL"))
    want = df.join(split, "route_id")
    got = splits.with_split(df, split)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("is_test = 1").count() == 20
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
