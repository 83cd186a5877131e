"""Queries of the data-quality operators."""

from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import quality as q
from stopwise.plans.catalogue import query

SEG_COLS = [f.name for f in schemas.GOLD_SEGMENTS]

JOIN_KEYS = """
SELECT count(*) FILTER (w.station_code IS NULL) AS routes_without_weather_match,
  count(*) FILTER (c.calendar_date IS NULL) AS routes_without_calendar_match
FROM rt LEFT JOIN wx w ON rt.station_code = w.station_code AND rt.route_date = w.weather_date
  LEFT JOIN cal c ON rt.route_date = c.calendar_date"""

ROUTE_CHECKS = """
SELECT count(*) FILTER (temperature_2m_mean_c IS NULL) AS routes_without_weather,
  count(*) FILTER (weekday IS NULL) AS routes_without_calendar,
  count(*) FILTER (package_count IS NULL) AS routes_without_packages,
  count(*) FILTER (stop_rows IS NULL) AS routes_without_stops,
  count(*) FILTER (total_haversine_distance_km IS NULL) AS routes_without_haversine_distance,
  count(*) FILTER (depot_to_first_stop_distance_km IS NULL) AS routes_without_depot_distance,
  count(*) FILTER (route_duration_seconds IS NULL) AS routes_without_duration,
  count(*) FILTER (other_scan_status_count <> 0) AS routes_with_unknown_scan_status,
  count(*) FILTER (abs(total_haversine_distance_km - depot_to_first_stop_distance_km
    - delivery_haversine_distance_km) > 0.001) AS routes_with_inconsistent_distance_split
FROM g_routes"""

SEGMENT_CHECKS = """
SELECT count(*) AS segments, count(DISTINCT route_id) AS routes,
  count(*) FILTER (travel_time_seconds IS NULL) AS segments_without_target,
  count(*) FILTER (segment_distance_km IS NULL) AS segments_without_distance,
  count(*) FILTER (station_code IS NULL) AS segments_without_station,
  count(*) FILTER (temperature_2m_mean_c IS NULL) AS segments_without_weather,
  count(*) FILTER (is_depot_segment = 1) AS depot_segments
FROM g_seg"""


@query("join_key_checks", "rt wx cal", JOIN_KEYS)
def _(k):
    return q.check_join_keys(k.get("routes"), k.get("weather"), k.get("calendar"))


@query("route_checks", "g_routes", ROUTE_CHECKS)
def _(k):
    return q.check_route_table(k.get("gold_routes"))


@query("segment_checks", "g_seg", SEGMENT_CHECKS)
def _(k):
    return q.check_segment_table(k.get("gold_segments"))


ZERO = sorted({c for cs in q.MUST_BE_ZERO.values() for c in cs})


@query("quality_gate", "rt wx cal g_routes g_seg", f"""
SELECT layer, check_name AS "check", value, CASE WHEN check_name IN
    ({", ".join(f"'{c}'" for c in ZERO)}) THEN value = 0 WHEN check_name = 'segments'
    THEN value > 0 ELSE true END AS ok
FROM (SELECT 'silver' AS layer, * FROM (UNPIVOT ({JOIN_KEYS}) ON COLUMNS(*)
    INTO NAME check_name VALUE value)
  UNION ALL SELECT 'gold_routes', * FROM (UNPIVOT ({ROUTE_CHECKS}) ON COLUMNS(*)
    INTO NAME check_name VALUE value)
  UNION ALL SELECT 'gold_segments', * FROM (UNPIVOT ({SEGMENT_CHECKS}) ON COLUMNS(*)
    INTO NAME check_name VALUE value)) c
UNION ALL
SELECT 'all', 'failed_checks',
  CAST((SELECT count(*) FILTER (routes_without_weather_match <> 0)
      + count(*) FILTER (routes_without_calendar_match <> 0) FROM ({JOIN_KEYS}) a)
    + (SELECT count(*) FILTER (routes_without_weather <> 0)
      + count(*) FILTER (routes_without_calendar <> 0)
      + count(*) FILTER (routes_without_packages <> 0)
      + count(*) FILTER (routes_without_stops <> 0) FROM ({ROUTE_CHECKS}) b)
    + (SELECT count(*) FILTER (segments_without_target <> 0)
      + count(*) FILTER (segments_without_distance <> 0)
      + count(*) FILTER (segments = 0) FROM ({SEGMENT_CHECKS}) d) AS BIGINT), false""")
def _(k):
    return q.quality_gate(
        {
            "silver": q.check_join_keys(k.get("routes"), k.get("weather"), k.get("calendar")),
            "gold_routes": q.check_route_table(k.get("gold_routes")),
            "gold_segments": q.check_segment_table(k.get("gold_segments")),
        }
    )


@query("weather_coverage", "rt wx", """
SELECT s.station_code, coalesce(n, 0) AS weather_days,
  CASE WHEN n IS NULL THEN 0 ELSE 1 END AS covered
FROM (SELECT DISTINCT station_code FROM rt) s
  LEFT JOIN (SELECT station_code, count(*) AS n FROM wx GROUP BY 1) w USING (station_code)""")
def _(k):
    return q.weather_coverage(k.get("routes"), k.get("weather"))


@query("source_manifest", "rt ks", """
SELECT station_code, round(avg(lat), 6) AS station_lat, round(avg(lng), 6) AS station_lng,
  count(*) AS routes_with_station_point, (SELECT min(route_date) FROM rt) AS date_min,
  (SELECT max(route_date) FROM rt) AS date_max, (SELECT count(*) FROM rt) AS route_count,
  (SELECT count(DISTINCT station_code) FROM rt) AS station_count
FROM ks WHERE stop_type = 'Station' GROUP BY 1""")
def _(k):
    return q.source_manifest(k.get("routes"), k.get("stops"))


def per_column(columns, cell):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {cell.format(c=c)} FROM t" for c in columns)


@query("null_profile", "g_seg", "SELECT * FROM (WITH t AS MATERIALIZED (SELECT * FROM g_seg) "
       + per_column(SEG_COLS, "count(*) - count({c}) AS nulls, "
                    "round((count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100, 4) AS percent")
       + ") x")
def _(k):
    return q.null_profile(k.get("gold_segments"))


FREQ = ("WITH t AS MATERIALIZED (SELECT * FROM g_seg), f AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, "
                             f"count(*) AS n FROM t GROUP BY 2" for c in SEG_COLS) + ")")


@query("constant_columns", "g_seg", f"""
SELECT * FROM ({FREQ} SELECT "column", count(*) AS distinct_values,
  round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_share,
  CASE WHEN count(*) <= 1 THEN 1 ELSE 0 END AS is_constant,
  CASE WHEN count(*) > 1 AND max(n) > 0.99::DOUBLE * CAST(sum(n) AS DOUBLE) THEN 1 ELSE 0 END
    AS is_near_constant FROM f GROUP BY 1) x""")
def _(k):
    return q.constant_columns(k.get("gold_segments"))


@query("cardinality", "g_seg", f"""
SELECT * FROM ({FREQ} SELECT "column", count(value) AS distinct_values FROM f GROUP BY 1) x""")
def _(k):
    return q.cardinality(k.get("gold_segments"))


PACKAGE_COLS = ", ".join(f.name for f in schemas.PACKAGES)


@query("duplicate_counts", "packages_", f"""
SELECT (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT {PACKAGE_COLS},
    count(*) AS n FROM packages_ GROUP BY ALL) a) AS duplicate_rows,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT route_id, stop_id, package_id,
    count(*) AS n FROM packages_ GROUP BY ALL) b) AS duplicate_keys""")
def _(k):
    return q.duplicate_counts(k.get("packages"), ["route_id", "stop_id", "package_id"])


@query("zero_negative_profile", "g_seg",
       "SELECT * FROM (WITH t AS MATERIALIZED (SELECT * FROM g_seg) "
       + per_column(schemas.SEGMENT_NUMERIC,
                    "count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} = 0) AS zeros, "
                    "round(count(*) FILTER ({c} = 0) / CAST(count(*) AS DOUBLE) * 100, 4)"
                    " AS zero_percent, CASE WHEN count(*) FILTER ({c} = 0) / "
                    "CAST(count(*) AS DOUBLE) > 0.05 THEN 1 ELSE 0 END AS many_zeros") + ") x")
def _(k):
    return q.negative_and_zero_profile(k.get("gold_segments"), schemas.SEGMENT_NUMERIC)


def pair_sql(table, columns, digits, where=""):
    """(a, b, r) for every pair, as one scan unpivoted."""
    cells = ", ".join(
        f'corr({a}, {b}) AS "{a}|{b}"' for i, a in enumerate(columns) for b in columns[i + 1:]
    )
    return (f"SELECT split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, "
            f"round(r, {digits}) + 0.0::DOUBLE AS r FROM (UNPIVOT (SELECT {cells} FROM {table} {where}) "
            f"ON COLUMNS(*) INTO NAME pair VALUE r) u WHERE NOT isnan(r)")


@query("equivalent_columns", "g_routes",
       pair_sql("g_routes", schemas.ROUTE_NUMERIC, 4) + " AND abs(r) > 0.9999")
def _(k):
    found = q.equivalent_columns(k.get("gold_routes"), schemas.ROUTE_NUMERIC)
    return found.select("a", "b", F.round("r", 4).alias("r"))


@query("table_counts", "rt ks packages_ wx", """
SELECT 'routes' AS table_name, count(*) AS row_count, count(DISTINCT route_id) AS routes FROM rt
UNION ALL SELECT 'stops', count(*), count(DISTINCT route_id) FROM ks
UNION ALL SELECT 'packages', count(*), count(DISTINCT route_id) FROM packages_
UNION ALL SELECT 'weather', count(*), NULL FROM wx""")
def _(k):
    return q.table_counts({t: k.get(t) for t in ("routes", "stops", "packages", "weather")})
