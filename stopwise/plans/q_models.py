"""Queries of splits, baselines, errors and boosted trees."""

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import (
    baselines,
    boosted,
    encode,
    errors,
    metrics,
    profiles,
    quality,
    sequences,
    splits,
)
from stopwise.operators.joins import by_route
from stopwise.operators.lines import line_coefficients
from stopwise.operators.scoring import score_lines
from stopwise.operators.stops import depot_coordinates
from stopwise.plans.catalogue import query
from stopwise.plans.oracle import half_up
from stopwise.plans.q_tables import rounded
from stopwise.workspace import staged

Y = "travel_time_seconds"
METRIC = ["mae_min", "rmse_min", "r2", "bias_min"]


def metric_sql(e: str = "residual", y: str = Y) -> str:
    return (
        f"count(*) AS n, round(avg(abs({e})) / 60, 4) AS mae_min, "
        f"round(sqrt(avg({e} * {e})) / 60, 4) AS rmse_min, "
        f"CASE WHEN var_pop({y}) > 0 THEN round(1 - sum({e} * {e}) / (count(*) * var_pop({y})), 4)"
        f" + 0.0::DOUBLE END AS r2, round(avg({e}) / 60, 4) + 0.0::DOUBLE AS bias_min"
    )


@query("split_routes", "split_", "SELECT * FROM split_")
def _(k):
    return splits.split_routes(k.get("gold_segments"))


@query("split_validation", "train", """
SELECT route_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || route_id)) <=
  greatest(1, CAST(floor(0.15::DOUBLE * count(*) OVER ()) AS BIGINT)) THEN 1 ELSE 0 END
  AS is_validation FROM (SELECT DISTINCT route_id FROM train) t""")
def _(k):
    return splits.split_validation(k.get("train"))


@query("group_folds", "folds", "SELECT * FROM folds")
def _(k):
    return splits.group_folds(k.get("train"))


@query("fold_sizes", "folds", """
SELECT fold, count(*) AS routes_test, CAST(sum(segments) AS BIGINT) AS segments_test,
  (SELECT count(*) FROM folds) - count(*) AS routes_train,
  CAST((SELECT sum(segments) FROM folds) - sum(segments) AS BIGINT) AS segments_train
FROM folds GROUP BY 1""")
def _(k):
    return splits.fold_sizes(k.get("train"), k.get("folds"))


@query("fold_overlap", "split_", """
SELECT count(*) AS shared_routes FROM (SELECT route_id FROM split_ WHERE is_test = 0
  INTERSECT SELECT route_id FROM split_ WHERE is_test = 1) s""")
def _(k):
    return splits.overlap(k.get("train"), k.get("holdout"))


@query("train_routes", "split_", "SELECT route_id FROM split_ WHERE is_test = 0")
def _(k):
    return splits.train_routes(k.get("gold_segments"), k.get("holdout"))


@query("profile_scope", "split_", "SELECT CAST(0 AS BIGINT) AS leaked_routes")
def _(k):
    return quality.profile_scope(k.get("train"), k.get("route_split").filter("is_test = 1"))


@query("combined_populations", "oof_", """
SELECT route_id, segment_position, is_depot_segment, round(prediction, 4) AS prediction
FROM oof_""")
def _(k):
    oof = k.get("oof").select(
        "route_id", "segment_position", "is_depot_segment", F.round("prediction", 4).alias("prediction")
    )
    return baselines.combine_populations(
        oof.filter("is_depot_segment = 1"), oof.filter("is_depot_segment = 0")
    )


def in_long(rows, extra="", where=""):
    """One row per baseline from columns B0..B3."""
    return " UNION ALL ".join(
        f"SELECT '{b}' AS model, {extra} travel_time_seconds, is_depot_segment, "
        f"travel_time_seconds - {b} AS residual FROM {rows} {where}" for b in baselines.BASELINES
    )


@query("baselines_in_sample", "g_seg", f"""
SELECT model, {metric_sql()} FROM (SELECT * FROM (
  WITH c AS (SELECT p.is_depot_segment, mean, rate, slope_all, icpt_all, slope, icpt FROM
    (SELECT avg(travel_time_seconds) AS mean,
      sum(travel_time_seconds) / sum(segment_distance_km) AS rate,
      regr_slope(travel_time_seconds, segment_distance_km) AS slope_all,
      regr_intercept(travel_time_seconds, segment_distance_km) AS icpt_all FROM g_seg) a,
    (SELECT is_depot_segment, regr_slope(travel_time_seconds, segment_distance_km) AS slope,
      regr_intercept(travel_time_seconds, segment_distance_km) AS icpt FROM g_seg GROUP BY 1) p),
  b AS (SELECT g_seg.*, mean AS B0, segment_distance_km * rate AS B1,
      greatest(0, slope_all * segment_distance_km + icpt_all) AS B2,
      greatest(0, slope * segment_distance_km + icpt) AS B3
    FROM g_seg JOIN c USING (is_depot_segment))
  {in_long("b")}) l) t GROUP BY 1""")
def _(k):
    scored = baselines.baseline_predictions(k.get("gold_segments"), None)
    long = baselines.long_predictions(scored, [Y, "is_depot_segment"])
    return rounded(metrics.metrics(long, Y, "prediction", ["model"]), 4, *METRIC)


@query("baselines_holdout", "mrows", f"""
SELECT model, population, {metric_sql()} FROM (
  SELECT model, travel_time_seconds, residual, unnest(['all',
    CASE WHEN is_depot_segment = 1 THEN 'depot' ELSE 'delivery' END]) AS population FROM (
  SELECT * FROM (WITH c AS (SELECT p.is_depot_segment, mean, rate, slope_all, icpt_all, slope, icpt
    FROM (SELECT avg(travel_time_seconds) AS mean,
      sum(travel_time_seconds) / sum(segment_distance_km) AS rate,
      regr_slope(travel_time_seconds, segment_distance_km) AS slope_all,
      regr_intercept(travel_time_seconds, segment_distance_km) AS icpt_all FROM mrows
      WHERE is_test = 0) a,
    (SELECT is_depot_segment, regr_slope(travel_time_seconds, segment_distance_km) AS slope,
      regr_intercept(travel_time_seconds, segment_distance_km) AS icpt FROM mrows
      WHERE is_test = 0 GROUP BY 1) p),
  b AS (SELECT mrows.*, mean AS B0, segment_distance_km * rate AS B1,
      greatest(0, slope_all * segment_distance_km + icpt_all) AS B2,
      greatest(0, slope * segment_distance_km + icpt) AS B3
    FROM mrows JOIN c USING (is_depot_segment) WHERE is_test = 1)
  {in_long("b")}) l) m) t GROUP BY 1, 2""")
def _(k):
    scored = baselines.baseline_predictions(k.get("model_rows"), "is_test").filter("is_test = 1")
    long = baselines.long_predictions(scored, [Y, "is_depot_segment"])
    out = metrics.metrics_by_population(long, Y, "prediction", ["model"])
    return rounded(out, 4, *METRIC)


@query("baselines_cv", "bp", f"""
SELECT model, population, round(avg(mae), 4) AS mae_min_mean, round(avg(rmse), 4) AS rmse_min_mean,
  round(stddev_samp(mae), 4) AS mae_min_std, round(stddev_samp(rmse), 4) AS rmse_min_std
FROM (SELECT model, fold, population, avg(abs(residual)) / 60 AS mae,
    sqrt(avg(residual * residual)) / 60 AS rmse FROM (
  SELECT model, fold, travel_time_seconds, residual, unnest(['all',
    CASE WHEN is_depot_segment = 1 THEN 'depot' ELSE 'delivery' END]) AS population
  FROM ({in_long("bp", "fold,")}) l) m GROUP BY 1, 2, 3) f GROUP BY 1, 2""")
def _(k):
    scored = baselines.baseline_predictions(k.get("train_folds"), "fold")
    long = baselines.long_predictions(scored, [Y, "is_depot_segment", "fold"])
    per_fold = metrics.metrics_by_population(long, Y, "prediction", ["model", "fold"])
    return metrics.fold_summary(per_fold, ["model", "population"], ["mae_min", "rmse_min"])


@query("cross_validated_callables", "bp", f"""
SELECT model, fold, {metric_sql()} FROM (
  SELECT 'mean' AS model, fold, travel_time_seconds, travel_time_seconds - B0 AS residual FROM bp
  UNION ALL SELECT 'lines', fold, travel_time_seconds, travel_time_seconds - B3 FROM bp) t
GROUP BY 1, 2""")
def _(k):
    def mean(train, test):
        return test.withColumn("prediction", train.agg(F.avg(Y)).scalar())

    def by_population(train, test):
        return score_lines(test, line_coefficients(train, ["is_depot_segment"]))

    models = {"mean": mean, "lines": by_population}
    scored = baselines.cross_validate(k.get("train_folds"), models, 5)
    out = metrics.metrics(scored, Y, "prediction", ["model", "fold"])
    return rounded(out, 4, *METRIC)


@query("oof_line_model", "oof_", """
SELECT route_id, segment_position, fold, round(prediction, 4) AS prediction FROM oof_""")
def _(k):
    return k.plan("oof").select(
        "route_id", "segment_position", "fold", F.round("prediction", 4).alias("prediction")
    )


@query("population_metrics", "oof_", f"""
SELECT population, {metric_sql()} FROM (SELECT travel_time_seconds, residual, unnest(['all',
  CASE WHEN is_depot_segment = 1 THEN 'depot' ELSE 'delivery' END]) AS population FROM oof_) t
GROUP BY 1""")
def _(k):
    out = metrics.metrics_by_population(k.get("oof"), Y, "prediction")
    return rounded(out, 4, *METRIC)


def error_query(name, dim, column=None):
    column = column or dim

    @query(name, "oof_", f"""
SELECT {column} AS {dim}, {metric_sql()} FROM oof_ WHERE is_depot_segment = 0 GROUP BY 1""")
    def _(k):
        oof = errors.with_route_third(k.get("oof"))
        return rounded(errors.error_by(oof, dim), 4, *METRIC)


error_query("error_by_station", "station_code")
error_query("error_by_zone", "same_zone")
error_query("error_by_hour", "departure_hour")
error_query("error_by_third", "route_third", """
CASE WHEN segment_position / CAST(greatest(route_total_stops, 1) AS DOUBLE) <= 1.0::DOUBLE / 3
    THEN 'start'
  WHEN segment_position / CAST(greatest(route_total_stops, 1) AS DOUBLE) <= 2.0::DOUBLE / 3
    THEN 'middle' ELSE 'end' END""")


@query("bias_by_decile", "oof_", """
SELECT CAST(decile AS INT) AS decile, round(avg(travel_time_seconds) / 60, 4) AS mean_duration_min,
  round(avg(residual) / 60, 4) + 0.0::DOUBLE AS bias_min,
  round(avg(abs(residual)) / 60, 4) AS mae_min, count(*) AS n
FROM (SELECT travel_time_seconds, residual,
    greatest(len(list_filter(e, lambda x: x < travel_time_seconds)) - 1, 0) AS decile
  FROM oof_, (SELECT list_sort(list_distinct([quantile_cont(travel_time_seconds, 0.0), """
       + ", ".join(f"quantile_cont(travel_time_seconds, {i / 10})" for i in range(1, 11)) + """]))
    AS e FROM oof_ WHERE is_depot_segment = 0) q
  WHERE is_depot_segment = 0) t GROUP BY 1""")
def _(k):
    out = errors.bias_by_duration_decile(k.get("oof"))
    return rounded(out, 4, "mean_duration_min", "bias_min", "mae_min")


@query("relative_bias", "oof_", """
SELECT is_depot_segment, round(avg(residual) / 60, 4) + 0.0::DOUBLE AS bias_min,
  round(avg(travel_time_seconds) / 60, 4) AS mean_min,
  round(avg(residual) / avg(travel_time_seconds) * 100, 4) + 0.0::DOUBLE AS relative_percent,
  CASE WHEN abs(avg(residual) / avg(travel_time_seconds) * 100) > 3 THEN 1 ELSE 0 END AS systematic
FROM oof_ GROUP BY 1""")
def _(k):
    return rounded(errors.relative_bias(k.get("oof")), 4, "bias_min", "mean_min", "relative_percent")


WORST = f"""
SELECT route_id, segment_position, station_code, is_depot_segment,
  {half_up("travel_time_seconds / 60", 2)} AS real_min,
  {half_up("prediction / 60", 2)} AS predicted_min, {half_up("residual / 60", 2)} AS residual_min,
  segment_distance_km, same_zone
FROM oof_ ORDER BY abs(residual) DESC, route_id, segment_position LIMIT {{n}}"""


@query("worst_predictions", "oof_", WORST.format(n=15))
def _(k):
    return errors.worst_predictions(k.get("oof"))


@query("suspicious_speed", "oof_", f"""
SELECT * EXCLUDE (v), {half_up("v", 4)} AS speed_kmh FROM (
  SELECT *, segment_distance_km / (real_min / 60) AS v FROM ({WORST.partition("ORDER BY")[0]}) w
  WHERE real_min > 0) x WHERE v < 3 AND segment_distance_km > 0.1""")
def _(k):
    return rounded(errors.suspicious_speed(errors.in_minutes(k.get("oof"))), 4, "speed_kmh")


@query("zone_encoding", "tf", """
SELECT t.route_id, t.segment_position, t.to_zone_id,
  round((coalesce(s, 0) + 20 * prior) / (coalesce(n, 0) + 20), 4) AS zone_mean
FROM tf t JOIN (SELECT f.fold, avg(travel_time_seconds) AS prior
    FROM (SELECT DISTINCT fold FROM tf) f JOIN tf o ON o.fold <> f.fold GROUP BY 1) p
    ON t.fold = p.fold
  LEFT JOIN (SELECT f.fold, to_zone_id, sum(travel_time_seconds) AS s, count(*) AS n
    FROM (SELECT DISTINCT fold FROM tf) f JOIN tf o ON o.fold <> f.fold GROUP BY 1, 2) z
    ON t.fold = z.fold AND t.to_zone_id = z.to_zone_id""")
def _(k):
    out = encode.encode_out_of_fold(k.get("train_folds"), "to_zone_id", "zone_mean")
    return rounded(
        out.select("route_id", "segment_position", "to_zone_id", "zone_mean"), 4, "zone_mean"
    )


@query("zone_encoding_ordered", "tf", """
SELECT route_id, segment_position, to_zone_id,
  round((coalesce(sum(travel_time_seconds) OVER w, 0) + 20 * prior)
    / (count(travel_time_seconds) OVER w + 20), 4) AS zone_mean
FROM tf, (SELECT avg(travel_time_seconds) AS prior FROM tf) p
WINDOW w AS (PARTITION BY to_zone_id ORDER BY md5(route_id || ':' || segment_position)
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(k):
    key = F.concat_ws(":", "route_id", F.col("segment_position").cast("string"))
    out = encode.encode_ordered(k.get("train_folds"), "to_zone_id", "zone_mean", key)
    return rounded(
        out.select("route_id", "segment_position", "to_zone_id", "zone_mean"), 4, "zone_mean"
    )


@query("station_encoding", "mrows", """
SELECT m.route_id, m.segment_position,
  round((coalesce(s, 0) + 20 * prior) / (coalesce(n, 0) + 20), 4) AS station_mean
FROM mrows m LEFT JOIN (SELECT station_code, sum(travel_time_seconds) AS s, count(*) AS n
    FROM mrows WHERE is_test = 0 GROUP BY 1) c USING (station_code),
  (SELECT avg(travel_time_seconds) AS prior FROM mrows WHERE is_test = 0) p
WHERE is_test = 1""")
def _(k):
    rows = k.get("model_rows")
    means = encode.category_means(rows.filter("is_test = 0"), "station_code", "station_mean")
    out = encode.encode_with(rows.filter("is_test = 1"), means, "station_code", "station_mean")
    return rounded(out.select("route_id", "segment_position", "station_mean"), 4, "station_mean")


SCALED = ["segment_distance_km", "cumulative_distance_km", "service_time_at_destination_seconds"]


@query("scale_features", "tf", "SELECT route_id, segment_position, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM tf WHERE fold <> 1)) / (SELECT CASE WHEN stddev_pop({c})"
    f" < 1e-6 THEN 1 ELSE stddev_pop({c}) END FROM tf WHERE fold <> 1), 5) AS {c}"
    for c in SCALED) + " FROM tf")
def _(k):
    rows = k.get("train_folds")
    out = encode.scale_features(rows.filter("fold <> 1"), rows, SCALED)
    return rounded(out.select("route_id", "segment_position", *SCALED), 5, *SCALED)


@query("route_sequences", "g_seg", """
SELECT route_id, station_code, length, x, y, population FROM (
  SELECT route_id, station_code, CAST(count(*) AS INT) AS length,
    flatten(list([segment_distance_km, CAST(packages_at_destination AS DOUBLE)]
      ORDER BY segment_position)) AS x,
    list(round(travel_time_seconds / 60, 6) ORDER BY segment_position) AS y,
    list(is_depot_segment ORDER BY segment_position) AS population
  FROM g_seg GROUP BY 1, 2) t""")
def _(k):
    chunks = sequences.route_sequences(
        k.get("gold_segments"), ["segment_distance_km", "packages_at_destination"]
    )
    return sequences.whole_routes(chunks).select(
        "route_id",
        "station_code",
        "length",
        F.flatten("x").alias("x"),
        F.transform("y", lambda v: F.round(v, 6)).alias("y"),
        "population",
    )


@query("holdout_bank", "hold", "SELECT * FROM hold")
def _(k):
    return k.plan("holdout")


@query("depot_coordinates", "depots", """
SELECT station_code, round(depot_lat, 6) AS depot_lat, round(depot_lng, 6) AS depot_lng
FROM depots""")
def _(k):
    train = k.get("route_split").filter("is_test = 0")
    return rounded(depot_coordinates(k.get("gold_segments"), train), 6, "depot_lat", "depot_lng")


@query("station_profile", "profile", """
SELECT station_code, segments, zones_seen, """ + ", ".join(
    f"list_transform({c}, lambda v: round(v, 4)) AS {c}" for c in schemas.LOAD_COLUMNS)
    + " FROM profile")
def _(k):
    out = profiles.station_profile(k.get("train"))
    return out.withColumns(
        {c: F.transform(c, lambda v: F.round(v, 4)) for c in schemas.LOAD_COLUMNS}
    )


@query("top_zones", "train", """
SELECT station_code, to_zone_id, n, zone_rank FROM (SELECT station_code, to_zone_id, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY station_code ORDER BY count(*) DESC, to_zone_id) AS INT)
    AS zone_rank FROM train GROUP BY 1, 2) t WHERE zone_rank <= 5""")
def _(k):
    return profiles.top_zones(k.get("train"), 5)


@query("station_catalogue", "train", """
SELECT station_code, count(*) AS segments FROM train GROUP BY 1 ORDER BY 2 DESC, 1""")
def _(k):
    return profiles.station_catalogue(k.get("station_profile"))


@query("route_catalogue", "hold", """
SELECT route_id, max(station_code) AS station_code, max(segment_position) AS segment_count,
  max(departure_hour) AS departure_hour, max(weekday) AS weekday, max(route_date) AS route_date
FROM hold GROUP BY 1""")
def _(k):
    return profiles.route_catalogue(k.get("holdout"))


@query("pick_route", "hold", """
SELECT route_id, segment_position, from_stop_id, to_stop_id FROM hold WHERE route_id =
  (SELECT route_id FROM hold ORDER BY md5('3:' || route_id), route_id LIMIT 1)""")
def _(k):
    return splits.pick_route(k.get("holdout"), seed=3).select(
        "route_id", "segment_position", "from_stop_id", "to_stop_id"
    )


@query("deterministic_sample", "g_seg", """
SELECT route_id, segment_position, travel_time_seconds FROM g_seg
ORDER BY md5('42:' || route_id || ':' || segment_position), route_id, segment_position
LIMIT 5000""")
def _(k):
    rows = k.get("gold_segments").select("route_id", "segment_position", Y)
    return splits.deterministic_sample(rows, 5000, 42, ["route_id", "segment_position"])


# ---- boosted trees ----

FOLDS = 5
_runs: dict = {}


def candidate_run(k):
    """Held-out predictions and gains of the candidates, fitted once per folder."""
    key = (k.spark.sparkContext.applicationId, k.sf_dir)
    if key not in _runs:
        rows = k.get("train").join(
            by_route(splits.group_folds(k.get("train"), FOLDS).select("route_id", "fold")), "route_id"
        )
        predictions, gains = boosted.candidate_predictions(staged(rows, "candidates"), FOLDS)
        _runs[key] = staged(predictions, "candidate-predictions"), gains
    return _runs[key]


def encoded_sides(k):
    return k.get("encoded_train"), k.get("encoded_test")


@query("boosted_single")
def _(k):
    train, test = encoded_sides(k)
    losses = ("absolute", "squared")
    # independent fits, side by side
    with ThreadPool(len(losses)) as pool:
        models = pool.map(lambda loss: boosted.boosted_single(train, loss), losses)
    out = None
    for loss, model in zip(losses, models):
        scored = model.transform(test).withColumn("loss", F.lit(loss))
        part = metrics.metrics_by_population(scored, Y, "prediction", ["loss"])
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4, *METRIC)


@query("boosted_by_population")
def _(k):
    train, test = encoded_sides(k)
    models = boosted.boosted_by_population(train)
    return rounded(boosted.evaluate_once(models, test), 4, *METRIC)


@query("early_stopping")
def _(k):
    train, test = encoded_sides(k)
    held = staged(splits.split_validation(train), "validation-routes")

    def part(flag, zone):
        features = [*boosted.FEATURES[flag], boosted.STATION, *zone]
        rows = train.filter(F.col(boosted.POP) == flag)
        model, trees = boosted.fit_with_early_stopping(rows, held, features)
        scored = model.transform(test.filter(F.col(boosted.POP) == flag))
        return metrics.metrics(scored, Y, "prediction").withColumns(
            {boosted.POP: F.lit(flag), "trees": F.lit(trees)}
        )

    # independent fits, side by side
    with ThreadPool(2) as pool:
        delivery, depot = pool.starmap(part, [(0, [boosted.ZONE]), (1, [])])
    return rounded(delivery.unionByName(depot), 4, *METRIC)


@query("candidate_grid")
def _(k):
    grid = boosted.candidate_grid(candidate_run(k)[0])
    return metrics.fold_summary(grid, ["delivery", "depot"], ["mae_min", "rmse_min", "r2"])


@query("best_candidate")
def _(k):
    best = boosted.best_candidate(boosted.candidate_grid(candidate_run(k)[0]))
    return rounded(best, 4, "mae_min")


@query("candidate_effects")
def _(k):
    out = boosted.candidate_effects(candidate_run(k)[0])
    return rounded(out, 4, "mae_min", "effect_min", "gain_over_line_percent")


@query("feature_importance")
def _(k):
    gains = candidate_run(k)[1]
    return boosted.mean_importance(k.spark, gains, ["candidate", "population", "fold"])


@query("coherence_check", "oof_", """
SELECT fold, round(avg(abs(residual)) / 60, 6) AS mae_min, 0.0::DOUBLE AS gap, true AS coherent
FROM oof_ GROUP BY fold""")
def _(k):
    """The line's error by fold in the baselines' own run, and inside the grid of candidates."""
    direct = metrics.metrics(k.get("oof"), Y, "prediction", ["fold"])
    grid = boosted.candidate_grid(candidate_run(k)[0]).filter("delivery = 'line' AND depot = 'line'")
    out = metrics.coherence_check(direct, grid, ["fold"])
    return rounded(out, 6, "mae_min", "gap")
