"""Queries of scoring, explanation, planning and streaming."""

from pyspark.sql import functions as F

from stopwise.operators import boosted, explain, joins, planning, scoring
from stopwise.plans.catalogue import query
from stopwise.plans.q_models import encoded_sides
from stopwise.plans.q_tables import rounded
from stopwise.streaming import score
from stopwise.workspace import new_path, staged

SCORED = """
SELECT route_id, segment_position, is_depot_segment, round(prediction, 4) AS prediction
FROM scored"""


def scored_columns(df):
    return df.select(
        "route_id", "segment_position", "is_depot_segment", F.round("prediction", 4).alias("prediction")
    )


@query("score_line_model", "scored", SCORED)
def _(k):
    return scored_columns(scoring.score_lines(k.get("holdout"), k.get("lines")))


@query("score_stream", "scored", SCORED)
def _(k):
    """Held-out segments without their target, arriving as files."""
    source, out, checkpoint = (new_path(k.spark, f"stream-{n}") for n in ("in", "out", "state"))
    rows = k.get("holdout").drop("travel_time_seconds")
    rows.write.parquet(source)
    stream = score.read_segment_stream(k.spark, source, rows.schema)
    score.run_to_files(scored_columns(score.score_stream(stream, k.get("lines"))), out, checkpoint)
    return k.spark.read.schema(
        "route_id string, segment_position int, is_depot_segment int, prediction double"
    ).parquet(out)


@query("arrival_seconds", "scored", """
SELECT route_id, segment_position, round(sum(prediction) OVER (PARTITION BY route_id
  ORDER BY segment_position), 3) AS arrival_seconds FROM scored""")
def _(k):
    hold = k.get("holdout")
    timed = scoring.with_arrival_seconds(scoring.score_lines(hold, k.get("lines")), extent=hold)
    return timed.select(
        "route_id", "segment_position", F.round("arrival_seconds", 3).alias("arrival_seconds")
    )


@query("route_eta", "scored rt", """
SELECT route_id, segment_position, to_stop_id, round(prediction, 3) AS seconds,
  round(arrival_seconds, 3) AS arrival_seconds,
  departure_timestamp_utc + to_milliseconds(CAST(round((arrival_seconds + service) * 1000)
    AS BIGINT)) AS eta
FROM (SELECT scored.*, departure_timestamp_utc, sum(prediction) OVER r AS arrival_seconds,
    coalesce(sum(service_time_at_destination_seconds) OVER (PARTITION BY route_id
      ORDER BY segment_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS service
  FROM scored JOIN (SELECT route_id, departure_timestamp_utc FROM rt) d USING (route_id)
  WINDOW r AS (PARTITION BY route_id ORDER BY segment_position)) t""")
def _(k):
    hold = k.get("holdout")
    departures = k.get("routes").select("route_id", "departure_timestamp_utc")
    scored = scoring.score_lines(hold, k.get("lines")).join(joins.by_route(departures), "route_id")
    timed = scoring.with_eta(scored, extent=hold)
    return timed.select(
        "route_id",
        "segment_position",
        "to_stop_id",
        F.round("prediction", 3).alias("seconds"),
        F.round("arrival_seconds", 3).alias("arrival_seconds"),
        "eta",
    )


@query("prediction_vs_actual", "scored", """
SELECT route_id, count(*) AS segment_count, round(sum(prediction), 3) AS predicted_seconds,
  round(sum(travel_time_seconds), 3) AS real_seconds FROM scored GROUP BY 1""")
def _(k):
    hold = k.get("holdout")
    scored = scoring.score_lines(hold.drop("travel_time_seconds"), k.get("lines"))
    totals = scoring.route_totals(joins.prediction_vs_actual(scored, hold))
    return rounded(totals, 3, "predicted_seconds", "real_seconds")


@query("route_case", "hold", "SELECT " + ", ".join(scoring.CASE_COLUMNS) + """,
  CAST([] AS VARCHAR[]) AS estimated_fields FROM hold
WHERE route_id = (SELECT min(route_id) FROM hold)""")
def _(k):
    hold = k.get("holdout")
    first = hold.agg(F.min("route_id")).first()[0]
    return scoring.route_case(hold, first)[0]


CONTRIBUTIONS = """
SELECT route_id, segment_position, hold.is_depot_segment, 'segment_distance_km' AS feature,
  segment_distance_km AS value, slope * (segment_distance_km - m) AS contribution_seconds,
  slope * m + icpt AS base_seconds
FROM hold JOIN line USING (is_depot_segment) JOIN (SELECT is_depot_segment,
  avg(segment_distance_km) AS m FROM train GROUP BY 1) t USING (is_depot_segment)"""


@query("line_contributions", "hold line train", f"""
SELECT * REPLACE (round(contribution_seconds, 4) + 0.0::DOUBLE AS contribution_seconds,
  round(base_seconds, 4) AS base_seconds) FROM ({CONTRIBUTIONS}) c""")
def _(k):
    out = explain.line_contributions(k.get("holdout"), k.get("lines"), k.get("train"))
    return rounded(out, 4, "contribution_seconds", "base_seconds")


@query("global_importance", "hold line train", f"""
SELECT is_depot_segment, feature, round(avg(abs(contribution_seconds)) / 60, 4) AS mean_abs_min,
  100.0::DOUBLE AS percent FROM ({CONTRIBUTIONS}) c GROUP BY 1, 2""")
def _(k):
    out = explain.line_contributions(k.get("holdout"), k.get("lines"), k.get("train"))
    return rounded(explain.global_importance(out), 4, "mean_abs_min", "percent")


def explained(k):
    """Contributions and predictions of the specialists on held-out segments, written on first use."""
    if "explained" not in k.written:
        train, test = encoded_sides(k)
        models = boosted.boosted_by_population(train)
        parts, scores = [], []
        for flag in boosted.FEATURES:
            features = boosted.features_of(flag)
            players = boosted.input_players(models[flag], features)
            rows = test.filter(F.col(boosted.POP) == flag)
            parts.append(explain.tree_contributions(rows, models[flag].stages[-1], features, players))
            scores.append(models[flag].transform(rows).select("route_id", "segment_position", "prediction"))
        k.written["explained"] = staged(parts[0].unionByName(parts[1]), "explained")
        k.written["explained_scores"] = staged(scores[0].unionByName(scores[1]), "explained-scores")
    return k.written["explained"]


@query("tree_contributions")
def _(k):
    out = explain.ordered_contributions(explained(k))
    return rounded(out, 4, "contribution_seconds", "base_seconds")


@query("tree_importance")
def _(k):
    return rounded(explain.global_importance(explained(k)), 4, "mean_abs_min", "percent")


@query("tree_additivity", "hold", """
SELECT is_depot_segment, count(*) AS segments, count(*) AS exact FROM hold GROUP BY 1""")
def _(k):
    """Segments whose base and contributions add up to the prediction."""
    keys = ["route_id", "segment_position"]
    sums = explained(k).groupBy(*keys, boosted.POP).agg(
        (F.sum("contribution_seconds") + F.max("base_seconds")).alias("total")
    )
    joined = sums.join(joins.by_route(k.written["explained_scores"]), keys)
    exact = F.abs(F.col("total") - F.col("prediction")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("prediction"))
    return joined.groupBy(boosted.POP).agg(F.count("*").alias("segments"), F.count(F.when(exact, 1)).alias("exact"))


@query("tree_importance_total", "hold", """
SELECT is_depot_segment, 100.0::DOUBLE AS percent FROM hold GROUP BY 1""")
def _(k):
    shares = explain.global_importance(explained(k)).groupBy(boosted.POP).agg(F.sum("percent").alias("percent"))
    return rounded(shares, 6, "percent")


@query("complete_planned_routes", "plegs", """
SELECT route_id, station_code, position, stop_id, from_stop_id, to_zone_id, same_zone,
  is_depot_segment, km AS segment_distance_km, cumulative_distance_km, packages_at_destination,
  round(service, 4) AS service_time_at_destination_seconds,
  round(volume, 4) AS volume_at_destination_cm3,
  round(windowed, 4) AS packages_with_window_at_destination, estimated_fields, departure_hour,
  weekday, route_total_stops, route_package_count FROM plegs""")
def _(k):
    out = k.plan("planned_routes").drop(
        "lat", "lng", "from_lat", "from_lng", "depot_lat", "depot_lng"
    )
    return rounded(out, 4, *planning.SAMPLED)


@query("propose_stop_order")
def _(k):
    out = planning.order_savings(k.get("proposals"), k.get("lines"))
    return rounded(
        out, 2, "original_seconds", "proposed_seconds", "saving_seconds", "saving_percent"
    )


@query("proposal_checks", "plegs line", """
SELECT route_id, count(*) AS stops, round(sum(greatest(0, slope * km + icpt)), 3) AS given_seconds,
  true AS is_permutation
FROM plegs JOIN line USING (is_depot_segment) GROUP BY 1""")
def _(k):
    """Does every proposal hold each stop of its route once, and what does the given order cost?"""
    proposals = k.get("proposals")
    given = planning.order_seconds(proposals, "position", k.get("lines")).withColumnRenamed("seconds", "given_seconds")
    stops, places = F.count("*"), F.countDistinct("proposed_position")
    same = F.bit_xor(F.xxhash64("position")) == F.bit_xor(F.xxhash64("proposed_position"))
    ends = (F.min("proposed_position") == 1) & (F.max("proposed_position") == stops)
    flags = proposals.groupBy("route_id").agg(stops.alias("stops"), (same & ends & (places == stops)).alias("is_permutation"))
    out = flags.join(joins.by_route(given), "route_id").select("route_id", "stops", "given_seconds", "is_permutation")
    return rounded(out, 3, "given_seconds")


@query("original_order_seconds", "plegs line", """
SELECT route_id, round(sum(greatest(0, slope * km + icpt)), 3) AS seconds
FROM plegs JOIN line USING (is_depot_segment) GROUP BY 1""")
def _(k):
    return rounded(
        planning.order_seconds(k.get("planned_routes"), "position", k.get("lines")), 3, "seconds"
    )


@query("reordered_eta")
def _(k):
    out = planning.reordered_eta(k.get("proposals"), k.get("lines"))
    return rounded(out, 3, "minutes", "arrival_minutes")
