"""Queries that build tables."""

from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions import scalars
from stopwise.functions.geo import located
from stopwise.operators import features, gold, joins, matrix, stops as st
from stopwise.plans import bronze
from stopwise.plans.catalogue import query
from stopwise.plans.oracle import half_up
from stopwise.sinks.tables import write_table
from stopwise.sources import documents
from stopwise.sources.tables import read_table
from stopwise.workspace import new_path


def rounded(df, digits, *columns):
    """Adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query("route_stop_summary", "stop_sum", "SELECT * FROM stop_sum")
def _(k):
    return st.route_stop_summary(k.get("stops"))


SUM_COLS = [
    "total_planned_service_time_seconds", "mean_planned_service_time_seconds",
    "total_package_volume_cm3", "mean_package_volume_cm3", "max_package_volume_cm3",
]


@query("route_package_summary", "pack_sum",
       "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in SUM_COLS)
       + ") FROM pack_sum")
def _(k):
    return rounded(st.route_package_summary(k.get("packages")), 4, *SUM_COLS)


@query("route_sequence_summary", "seq_sum", "SELECT * FROM seq_sum")
def _(k):
    return st.route_sequence_summary(k.get("sequences"))


@query("route_distance_split", "dist", "SELECT * FROM dist")
def _(k):
    return st.route_distance_split(k.get("stops"), k.get("sequences"))


@query("route_travel_time", "tt", "SELECT * FROM tt")
def _(k):
    return st.route_travel_time(k.get("segments"))


@query("gold_routes", "g_routes", "SELECT * FROM g_routes")
def _(k):
    return k.plan("gold_routes")


@query("stop_load", "load", "SELECT * FROM load")
def _(k):
    return st.stop_load(k.get("packages"))


@query("gold_segments", "g_seg", "SELECT * FROM g_seg")
def _(k):
    return k.plan("gold_segments")


@query("cumulative_distance", "g_seg", """
SELECT route_id, segment_position, segment_distance_km, cumulative_distance_km FROM g_seg""")
def _(k):
    return gold.gold_legs(k.get("segments"), k.get("stops")).select(
        "route_id", "segment_position", "segment_distance_km", "cumulative_distance_km"
    )


# ---- from raw documents in files ----


def raw(k, name):
    """Folders of raw documents, written on first use."""
    build = {
        "routes": lambda: bronze.route_lines(k.get("keyed_routes"), k.get("keyed_stops")),
        "packages": lambda: bronze.package_lines(k.get("packages")),
        "sequences": lambda: bronze.sequence_lines(k.get("keyed_stops")),
        "scores": lambda: bronze.score_lines(k.get("invalid_scores")),
        "matrix": lambda: bronze.matrix_lines(k.get("keyed_stops"), k.get("segments")),
        "weather": lambda: bronze.weather_lines(k.get("weather"), documents.DAILY),
        "holidays": lambda: bronze.holiday_lines(k.get("holidays")),
    }
    if name not in k.raw:
        docs = build[name]()
        if name in ("weather", "holidays"):
            k.raw[name] = [new_path(k.spark, f"raw-{name}")]
            docs.write.text(k.raw[name][0])
        else:
            k.raw[name] = bronze.written(docs, f"raw-{name}")
    return k.raw[name]


@query("silver_routes", "rt", """
SELECT * REPLACE (round(avg_stop_lat, 9) AS avg_stop_lat, round(avg_stop_lng, 9) AS avg_stop_lng)
FROM rt""")
def _(k):
    return rounded(documents.read_routes(k.spark, raw(k, "routes")), 9, "avg_stop_lat", "avg_stop_lng")


@query("silver_stops", "ks", """
SELECT route_id, stop_id, station_code, route_date, lat, lng, stop_type, zone_id, is_station
FROM ks""")
def _(k):
    return documents.read_stops(k.spark, raw(k, "routes"))


@query("silver_packages", "packages_", "SELECT * FROM packages_")
def _(k):
    return documents.read_packages(k.spark, raw(k, "packages"))


@query("silver_sequences", "ks", """
SELECT route_id, stop_id, position AS actual_sequence_position FROM ks""")
def _(k):
    return documents.read_sequences(k.spark, raw(k, "sequences"))


@query("invalid_scores", "inv", "SELECT * FROM inv")
def _(k):
    return documents.read_invalid_scores(k.spark, raw(k, "scores"))


@query("travel_segments", "seg", """
SELECT * FROM seg WHERE (CAST(substr(route_id, 2) AS BIGINT) + segment_position) % 97 <> 0""")
def _(k):
    return matrix.travel_segments(k.get("sequences"), documents.read_matrix_rows(k.spark, raw(k, "matrix")))


@query("travel_matrix", "seg", """
SELECT route_id, from_stop_id, to_stop_id, travel_time_seconds FROM seg
WHERE (CAST(substr(route_id, 2) AS BIGINT) + segment_position) % 97 <> 0
UNION ALL SELECT route_id, to_stop_id, from_stop_id, travel_time_seconds + 1 FROM seg""")
def _(k):
    return documents.read_travel_matrix(k.spark, raw(k, "matrix"))


@query("pair_lookup", "seg", """
SELECT * FROM seg WHERE (CAST(substr(route_id, 2) AS BIGINT) + segment_position) % 97 <> 0""")
def _(k):
    pairs = st.consecutive_pairs(k.get("sequences"))
    return st.lookup_consecutive_pairs(pairs, documents.read_travel_matrix(k.spark, raw(k, "matrix")))


@query("matrix_coverage", "ks seg", """
SELECT (SELECT count(DISTINCT route_id) FROM seg) AS travel_time_routes,
  CAST(0 AS BIGINT) AS routes_without_sequence, count(*) AS expected_segments,
  count(*) FILTER ((CAST(substr(route_id, 2) AS BIGINT) + segment_position) % 97 = 0)
    AS missing_segments,
  count(*) FILTER ((CAST(substr(route_id, 2) AS BIGINT) + segment_position) % 97 <> 0)
    AS travel_time_segments
FROM seg""")
def _(k):
    return matrix.matrix_coverage(k.get("sequences"), documents.read_matrix_rows(k.spark, raw(k, "matrix")))


@query("weather_daily", "wx", "SELECT * FROM wx")
def _(k):
    return documents.read_weather(k.spark, raw(k, "weather"), wholetext=False)


@query("holidays", "hol", "SELECT * FROM hol")
def _(k):
    return documents.read_holidays(k.spark, raw(k, "holidays"), wholetext=False)


@query("calendar_daily", "cal", "SELECT * FROM cal")
def _(k):
    return k.plan("calendar")


# ---- small table operators ----


@query("route_stop_counts", "rt", """
SELECT route_id, total_stops, dropoff_stops, station_stops, round(avg_stop_lat, 9) AS avg_stop_lat,
  round(avg_stop_lng, 9) AS avg_stop_lng FROM rt""")
def _(k):
    return rounded(st.route_stop_counts(k.get("stops")), 9, "avg_stop_lat", "avg_stop_lng")


@query("station_centroids", "ks", """
SELECT station_code, round(avg(lat), 6) AS station_lat, round(avg(lng), 6) AS station_lng,
  count(*) AS routes_with_station_point
FROM ks WHERE stop_type = 'Station' GROUP BY 1""")
def _(k):
    return st.station_centroids(k.get("stops"), 6)


@query("located_stops", "ks", """
SELECT route_id, stop_id, lat, lng FROM ks WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def _(k):
    return located(k.get("stops")).select("route_id", "stop_id", "lat", "lng")


@query("sequenced_stops", "ks", """
SELECT route_id, stop_id, stop_type, lat, lng, position AS actual_sequence_position FROM ks""")
def _(k):
    return st.sequenced_stops(k.get("stops"), k.get("sequences")).select(
        "route_id", "stop_id", "stop_type", "lat", "lng", "actual_sequence_position"
    )


@query("consecutive_pairs", "seg", """
SELECT route_id, segment_position, from_stop_id, to_stop_id FROM seg""")
def _(k):
    return st.consecutive_pairs(k.get("sequences"))


@query("previous_stop", "ks", """
SELECT route_id, stop_id, position, lag(lat) OVER w AS prev_lat, lag(lng) OVER w AS prev_lng,
  lag(stop_type) OVER w AS prev_type FROM ks
WINDOW w AS (PARTITION BY route_id ORDER BY position)""")
def _(k):
    walk = st.sequenced_stops(k.get("stops"), k.get("sequences"))
    return st.with_previous_stop(walk, extent=k.get("sequences")).select(
        "route_id",
        "stop_id",
        F.col("actual_sequence_position").alias("position"),
        "prev_lat",
        "prev_lng",
        "prev_type",
    )


@query("stop_roles", "seg ks", """
SELECT s.route_id, segment_position, o.stop_type AS from_stop_type, o.zone_id AS from_zone_id,
  d.zone_id AS to_zone_id
FROM seg s LEFT JOIN ks o ON s.route_id = o.route_id AND s.from_stop_id = o.stop_id
  LEFT JOIN ks d ON s.route_id = d.route_id AND s.to_stop_id = d.stop_id""")
def _(k):
    return gold.with_stop_roles(k.get("segments"), k.get("stops")).select(
        "route_id", "segment_position", "from_stop_type", "from_zone_id", "to_zone_id"
    )


@query("route_context", "rt packages_ wx cal", """
SELECT rt.route_id, rt.station_code, rt.route_date,
  CAST(hour(departure_timestamp_utc) AS INT) AS departure_hour, total_stops AS route_total_stops,
  route_package_count, temperature_2m_mean_c, rain_sum_mm, wind_speed_10m_max_kmh, weekday,
  is_weekend
FROM rt LEFT JOIN (SELECT route_id, count(*) AS route_package_count FROM packages_ GROUP BY 1) p
    USING (route_id)
  LEFT JOIN wx ON rt.station_code = wx.station_code AND rt.route_date = wx.weather_date
  LEFT JOIN cal ON rt.route_date = cal.calendar_date""")
def _(k):
    return gold.route_context(
        k.get("routes"), k.get("packages"), k.get("weather"), k.get("calendar")
    )


@query("routes_without_travel_times", "g_routes", """
SELECT route_id, package_count, total_haversine_distance_km,
  CAST(NULL AS DOUBLE) AS total_travel_time_seconds, CAST(NULL AS DOUBLE) AS route_duration_hours
FROM g_routes""")
def _(k):
    names = ("routes", "invalid_scores", "stops", "packages", "sequences", "weather", "calendar")
    return gold.gold_routes(*[k.get(n) for n in names]).select(
        "route_id",
        "package_count",
        "total_haversine_distance_km",
        "total_travel_time_seconds",
        "route_duration_hours",
    )


@query("unmatched_routes", "rt wx", """
SELECT route_id, station_code, route_date FROM rt
WHERE NOT EXISTS (SELECT 1 FROM wx WHERE wx.station_code = rt.station_code
  AND wx.weather_date = rt.route_date)""")
def _(k):
    w = k.get("weather").withColumnRenamed("weather_date", "route_date")
    missing = joins.unmatched(k.get("routes"), w, ["station_code", "route_date"])
    return missing.select("route_id", "station_code", "route_date")


@query("model_features", "g_seg", "SELECT " + ", ".join(schemas.MODEL_COLUMNS).replace(
    "same_zone", "coalesce(same_zone, 0) AS same_zone").replace(
    "to_zone_id", "coalesce(to_zone_id, 'SIN_ZONA') AS to_zone_id") + " FROM g_seg")
def _(k):
    return features.leak_free_features(k.get("gold_segments"))


@query("depot_population", "g_seg", """
SELECT route_id, segment_position, travel_time_seconds FROM g_seg WHERE is_depot_segment = 1""")
def _(k):
    return features.population(k.get("gold_segments"), depot=True).select(
        "route_id", "segment_position", "travel_time_seconds"
    )


@query("zone_transitions", "ks", """
SELECT route_id, stop_id, position, zone_id,
  CASE WHEN zone_id = lag(zone_id) OVER w THEN 1 ELSE 0 END AS same_zone_as_previous
FROM ks WINDOW w AS (PARTITION BY route_id ORDER BY position)""")
def _(k):
    walk = k.get("keyed_stops").select("route_id", "stop_id", "position", "zone_id")
    return features.same_zone_as_previous(walk, "position")


@query("table_round_trip", "g_seg", "SELECT * FROM g_seg")
def _(k):
    path = new_path(k.spark, "round-trip")
    write_table(k.get("gold_segments"), path, schemas.GOLD_SEGMENTS, csv=True)
    by_csv = k.spark.read.schema(schemas.GOLD_SEGMENTS).csv(f"{path}.csv", header=True)
    by_parquet = read_table(k.spark, path, schemas.GOLD_SEGMENTS)
    return by_parquet.intersectAll(by_csv)  # rows that are equal in every column


@query("scalar_functions", "g_seg", f"""
SELECT route_id, segment_position, substr(station_code, 2, 2) AS city,
  CASE WHEN p <= 1.0::DOUBLE / 3 THEN 'start' WHEN p <= 2.0::DOUBLE / 3 THEN 'middle' ELSE 'end'
    END AS route_third,
  CASE WHEN travel_time_seconds > 0
    THEN {half_up("segment_distance_km / (travel_time_seconds / 60 / 60)", 4)} END AS speed_kmh,
  round(ln(1 + travel_time_seconds), 6) AS log_seconds
FROM (SELECT *, segment_position / CAST(greatest(route_total_stops, 1) AS DOUBLE) AS p
  FROM g_seg) s""")
def _(k):
    return k.get("gold_segments").select(
        "route_id",
        "segment_position",
        scalars.city_code(F.col("station_code")).alias("city"),
        scalars.route_third(F.col("segment_position"), F.col("route_total_stops")).alias(
            "route_third"
        ),
        F.round(
            scalars.implied_speed_kmh(
                F.col("segment_distance_km"), F.col("travel_time_seconds") / 60
            ),
            4,
        ).alias("speed_kmh"),
        F.round(F.log1p("travel_time_seconds"), 6).alias("log_seconds"),
    )
