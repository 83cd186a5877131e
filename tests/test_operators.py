"""Traps and invariants of single operators on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions import scalars
from stopwise.functions.geo import haversine_km
from stopwise.operators import (
    baselines,
    encode,
    errors,
    explain,
    features,
    gold,
    joins,
    matrix,
    metrics,
    planning,
    quality,
    rank_tests,
    scoring,
    sequences,
    splits,
    stops as st,
)
from stopwise.sinks import tables as sinks
from stopwise.sources import documents, tables


def text(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_nan_windows_and_bad_dimensions(spark):
    doc = (
        '{"R1": {"S1": {"P1": {"scan_status": "DELIVERED", "planned_service_time_seconds": 9.0,'
        ' "dimensions": {"depth_cm": 2, "height_cm": 3, "width_cm": NaN},'
        ' "time_window": {"start_time_utc": NaN, "end_time_utc": NaN}},'
        ' "P2": {"scan_status": "LOST", "planned_service_time_seconds": NaN,'
        ' "dimensions": {"depth_cm": 2, "height_cm": 3, "width_cm": 4},'
        ' "time_window": {"start_time_utc": NaN, "end_time_utc": "2018-07-28 10:00:00"}}}}}'
    )
    a, b = documents.parse_packages(text(spark, doc)).orderBy("package_id").collect()
    assert (a.has_time_window, a.volume_cm3, a.time_window_end_utc) == (0, None, None)
    assert (b.has_time_window, b.volume_cm3, b.planned_service_time_seconds) == (1, 24.0, None)
    summary = st.route_package_summary(documents.parse_packages(text(spark, doc))).first()
    assert (summary.package_count, summary.other_scan_status_count) == (2, 1)


def test_route_lines_merge(spark):
    head = '"station_code": "DLA1", "date_YYYY_MM_DD": "2018-07-28", "departure_time_utc": "16:02:10"'
    docs = text(
        spark,
        '{"R1": {%s, "route_score": "Best", "stops": {"A": {"lat": 1.0, "lng": 2.0, "type": "Station",'
        ' "zone_id": NaN}}}}' % head,
        '{"R1": {%s, "route_score": "Best", "stops": {"B": {"lat": 3.0, "lng": null,'
        ' "type": "Dropoff", "zone_id": "Z"}}}}' % head,
    )
    r = documents.parse_routes(docs).first()
    assert (r.total_stops, r.dropoff_stops, r.station_stops) == (2, 1, 1)
    assert (r.avg_stop_lat, r.avg_stop_lng, r.route_score_numeric) == (2.0, 2.0, None)
    assert r.departure_time_utc == "16:02:10"
    zones = {s.stop_id: s.zone_id for s in documents.parse_stops(docs).collect()}
    assert zones == {"A": None, "B": "Z"}


def test_matrix_gaps_and_unknown_routes(spark):
    rows = documents.parse_matrix_rows(
        text(spark, '{"R1": {"A": {"B": 5.0}, "B": {"A": 6.0}}}', '{"R9": {"A": {"B": 1.0}}}')
    )
    seq = spark.createDataFrame(
        [("R1", "A", 0), ("R1", "B", 4), ("R1", "C", 9), ("R2", "A", 0)], schemas.SEQUENCES
    )
    assert [tuple(r) for r in matrix.travel_segments(seq, rows).collect()] == [("R1", 1, "A", "B", 5.0)]
    c = matrix.matrix_coverage(seq, rows).first()
    assert (c.travel_time_routes, c.routes_without_sequence) == (2, 1)
    assert (c.expected_segments, c.missing_segments, c.travel_time_segments) == (2, 1, 1)


def test_scalars(spark):
    one = spark.range(1)
    km = one.select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert km == pytest.approx(math.pi * 6371.0088)
    row = one.select(
        scalars.safe_ratio(F.lit(1), F.lit(0)),
        scalars.same_zone(F.lit(None).cast("string"), F.lit("Z")),
        scalars.route_third(F.lit(0), F.lit(0)),
        scalars.score_to_numeric(F.lit("High")),
        scalars.rain_flag(F.lit(None).cast("double")),
    ).first()
    assert tuple(row) == (None, None, "start", 3, 0)


def test_optional_join_types(spark):
    from pyspark.sql import types as T

    cols = T.StructType([T.StructField("x", T.DoubleType())])
    out = joins.optional_join(spark.range(1), None, ["id"], cols)
    assert out.schema["x"].dataType == T.DoubleType() and out.first()["x"] is None


def test_one_stop_route_has_no_distance(spark):
    stops = spark.createDataFrame([("R1", "D", 1.0, 1.0, "Station")], "route_id string, stop_id string, lat double, lng double, stop_type string")
    seq = spark.createDataFrame([("R1", "D", 0)], schemas.SEQUENCES)
    r = st.route_distance_split(stops, seq).first()
    assert r.total_haversine_distance_km is None
    assert gold.with_cumulative_distance(
        spark.createDataFrame([("R1", 1, 2.0)], "route_id string, segment_position int, segment_distance_km double")
    ).first().cumulative_distance_km == 0.0


def test_leaks_are_refused(spark):
    with pytest.raises(ValueError, match="route_score"):
        features.leak_free_features(spark.range(1), ["route_score"])


def scored_rows(spark, y):
    rows = [("R", i, 0, 1.0, float(v), float(v) + 60) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "route_id string, segment_position int, is_depot_segment int, segment_distance_km double, travel_time_seconds double, prediction double")


def test_metrics_of_constant_target(spark):
    m = metrics.metrics(scored_rows(spark, [5, 5, 5]), "travel_time_seconds", "prediction").first()
    assert (m.mae_min, m.r2, m.bias_min) == (1.0, None, -1.0)


def test_deciles_with_equal_edges(spark):
    d = errors.bias_by_duration_decile(scored_rows(spark, [0] * 50 + list(range(1, 51)))).collect()
    assert sum(r.n for r in d) == 100
    assert max(r.n for r in d) >= 50


def test_splits_cover_and_folds_balance(spark):
    segs = spark.range(3000).select(
        F.concat(F.lit("R"), F.col("id") % 101).alias("route_id"), F.col("id").alias("segment_position")
    )
    s = splits.split_routes(segs).toPandas()
    assert len(s) == 101 and s["is_test"].sum() == 20
    f = splits.group_folds(segs, 5).toPandas()
    assert f["route_id"].is_unique and f["fold"].value_counts().max() - f["fold"].value_counts().min() <= 1
    with pytest.raises(AssertionError):
        splits.assert_disjoint_routes(segs, segs.limit(1))


def test_fold_baseline_ignores_own_fold(spark):
    rows = [("A", 1, 0, 1.0, 10.0, 1), ("B", 1, 0, 2.0, 20.0, 2), ("C", 1, 0, 3.0, 60.0, 2)]
    df = spark.createDataFrame(rows, "route_id string, segment_position int, is_depot_segment int, segment_distance_km double, travel_time_seconds double, fold int")
    got = {r.route_id: r for r in baselines.baseline_predictions(df, "fold").collect()}
    assert got["A"].B0 == 40.0 and got["B"].B0 == 10.0
    assert got["A"].B3 == 0.0  # 40 x - 60 at x = 1, floored
    enc = {r.route_id: r.m for r in encode.encode_out_of_fold(df, "route_id", "m").collect()}
    assert enc["A"] == 40.0


def test_rank_tests_against_textbook(spark):
    a, b = [1.1, 2.2, 3.3, 3.3], [0.5, 2.2, 4.4, 5.5, 6.6]
    rows = [(v, 1, "a") for v in a] + [(v, 0, "b") for v in b]
    df = spark.createDataFrame(rows, "v double, f int, g string")
    m = rank_tests.mann_whitney(df, "v", "f").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert m.u == pytest.approx(u)
    k = rank_tests.kruskal_wallis(df, "v", "g", min_n=0).first()
    assert 0 < k.p_value < 1 and k.groups == 2


def test_quality_gate_goes_red(spark):
    good = spark.createDataFrame([(0, 0)], "routes_without_weather_match int, routes_without_calendar_match int")
    bad = spark.createDataFrame([(3, 0)], "routes_without_weather_match int, routes_without_calendar_match int")
    assert quality.quality_gate({"silver": good}).filter("layer = 'all'").first().ok
    assert not quality.quality_gate({"silver": bad}).filter("layer = 'all'").first().ok


def test_sequences_are_chunked_whole(spark):
    df = spark.range(1, 26).select(
        F.lit("R").alias("route_id"), F.lit("S").alias("station_code"), F.col("id").cast("int").alias("segment_position"),
        F.col("id").cast("double").alias("km"), F.lit(60.0).alias("travel_time_seconds"), F.lit(0).alias("is_depot_segment"),
    )
    out = sequences.route_sequences(df, ["km"], rows=10).orderBy("chunk").collect()
    assert [v[0] for r in out for v in r.x] == [float(i) for i in range(1, 26)]


def test_two_opt_is_a_permutation_and_no_worse():
    rng = np.random.default_rng(0)
    xy = rng.random((40, 2))
    between = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    start = np.linalg.norm(xy, axis=1)

    def total(order):
        return start[order[0]] + between[order[:-1], order[1:]].sum()

    better = planning.improve_order(start, between)
    assert sorted(better) == list(range(40)) and total(better) <= total(np.arange(40)) + 1e-9
    # no reversal of a run of stops is left that would help
    for i in range(39):
        for j in range(i + 1, 40):
            other = np.concatenate([better[:i], better[i : j + 1][::-1], better[j + 1 :]])
            assert total(other) >= total(better) - 1e-9


def test_trees_keep_rows_with_unknown_values(spark):
    from stopwise.operators import boosted, scoring

    rows = [(f"R{i}", i, float(i % 7) if i % 5 else None, 1.0 if i % 3 else None, float(i % 7 * 10), i % 2 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "route_id string, segment_position int, a double, b double, travel_time_seconds double, is_depot_segment int")
    model = boosted.regressor(["a", "b"], trees=3, depth=3, loss="squared").fit(df)
    assert model.transform(df).filter("prediction IS NOT NULL").count() == 200
    assert len(boosted.importance(model, ["a", "b"])) == 2
    scored = scoring.score_segments(df, {0: model})
    assert scored.count() == 200
    assert scored.filter("prediction IS NOT NULL").count() == df.filter("is_depot_segment = 0").count()


@pytest.mark.parametrize("window", [4, 256])
def test_proposal_keeps_every_stop(spark, window):
    rows = [("R", i, f"S{i}", 40 + (i * 37 % 11) / 100, -73 - (i * 17 % 13) / 100) for i in range(1, 11)]
    stops = spark.createDataFrame(rows, "route_id string, position int, stop_id string, lat double, lng double").select(
        "*", F.lit("D").alias("station_code"), F.lit(None).cast("string").alias("to_zone_id"), F.lit(1).alias("packages_at_destination"),
        *[F.lit(None).cast("double").alias(c) for c in planning.SAMPLED], F.lit(9).alias("departure_hour"), F.lit(0).alias("weekday"),
    )
    profile = spark.createDataFrame([], "station_code string, zones_seen array<string>, " + ", ".join(f"{c} array<double>" for c in planning.SAMPLED))
    depots = spark.createDataFrame([], "station_code string, depot_lat double, depot_lng double")
    planned = planning.complete_planned_routes(stops, profile, depots, 1)
    first = planned.filter("position = 1").first()
    assert "origin" in first.estimated_fields and first.segment_distance_km == 0.0
    assert planned.filter("to_zone_id = 'SIN_ZONA'").count() == 10
    lines = spark.createDataFrame([(0, 60.0, 10.0), (1, 30.0, 100.0)], "is_depot_segment int, slope double, intercept double")
    prop = planning.propose_stop_order(planned, lines, window)
    assert sorted(r.proposed_position for r in prop.collect()) == list(range(1, 11))
    assert {r.stop_id for r in prop.collect()} == {f"S{i}" for i in range(1, 11)}
    saved = planning.order_savings(prop, lines).first()
    eta = planning.reordered_eta(prop, lines).agg(F.max("arrival_minutes")).first()[0]
    assert eta * 60 == pytest.approx(saved.proposed_seconds)


def test_path_contributions_add_up(spark):
    from stopwise.operators import boosted

    df = spark.range(400).select(
        F.concat(F.lit("R"), F.col("id")).alias("route_id"), F.lit(1).alias("segment_position"), F.lit(0).alias("is_depot_segment"),
        (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
    ).withColumn("travel_time_seconds", F.col("a") * 3 + F.col("b") * F.col("b"))
    model = boosted.regressor(["a", "b"], trees=4, depth=3, loss="squared").fit(df)
    c = explain.tree_contributions(df, model.stages[-1], ["a", "b"])
    total = c.groupBy("route_id").agg((F.sum("contribution_seconds") + F.max("base_seconds")).alias("p"))
    gap = total.join(model.transform(df), "route_id").agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0]
    assert gap < 1e-6
    scored = scoring.score_segments(df, {0: model})
    assert scored.count() == 400 and scored.filter("prediction < 0").count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("R1", "A", 0), ("R1", "B", 1)], schemas.SEQUENCES)
    sinks.write_table(df, f"{tmp_path}/seq", schemas.SEQUENCES, csv=True, one_file=True)
    assert tables.read_table(spark, f"{tmp_path}/seq", schemas.SEQUENCES).count() == 2
    sinks.write_table(df, f"{tmp_path}/only", schemas.SEQUENCES, csv=True)
    csv_only = spark.read.schema(schemas.SEQUENCES).csv(f"{tmp_path}/only.csv", header=True)
    csv_only.write.csv(f"{tmp_path}/plain.csv", header=True)
    assert tables.read_table(spark, f"{tmp_path}/plain.csv", schemas.SEQUENCES).count() == 2
    sinks.write_checks(quality.long_checks("x", spark.createDataFrame([(1,)], "n int")), f"{tmp_path}/checks")
    assert spark.read.json(f"{tmp_path}/checks").first()["check"] == "n"
    sinks.write_oof(df, {"by": df}, f"{tmp_path}/oof")
    sinks.write_station_profile(
        spark.createDataFrame([("D", 1)], "station_code string, n int"),
        spark.createDataFrame([], "station_code string, depot_lat double"), f"{tmp_path}/profile",
    )
    assert spark.read.parquet(f"{tmp_path}/profile").first()["depot_lat"] is None


def test_model_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from stopwise.operators import boosted

    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("travel_time_seconds"))
    model = boosted.regressor(["a"], trees=2, depth=2).fit(df)
    sinks.save_model({"delivery": model}, {"target": "travel_time_seconds", "mae_min": 1.0}, f"{tmp_path}/m", spark)
    again = PipelineModel.load(f"{tmp_path}/m/delivery")
    assert again.transform(df).count() == 50
    assert spark.read.json(f"{tmp_path}/m/manifest").first()["target"] == "travel_time_seconds"


def test_read_model_columns(spark, tmp_path):
    from stopwise.plans.lake import lake

    rows = lake(spark, "/root/testdata/sf0.001").get("gold_segments")
    rows.write.parquet(f"{tmp_path}/gold.parquet")
    out = tables.read_model_columns(spark, f"{tmp_path}/gold")
    assert set(out.columns) == set(schemas.MODEL_COLUMNS) and out.filter("same_zone IS NULL").count() == 0
