"""The registered queries once more, as plain SQL over the given tables."""

_H = (
    "(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat))"
    " * pow(sin(radians({b}lng - {a}lng) / 2), 2))"
)
KM = f"(2 * 6371.0088 * asin(sqrt(CASE WHEN {_H} > 1 THEN 1 ELSE {_H} END)))"

# name -> (tables it needs, select)
CTE: dict[str, tuple[str, str]] = {}


def _cte(name: str, needs: str, sql: str) -> None:
    CTE[name] = (needs, sql)


_cte("kr", "", """
SELECT o_orderkey AS rk, c_nationkey AS nk, 'R' || o_orderkey AS route_id,
  'D' || substr(r_name, 1, 2) || c_nationkey AS station_code,
  CAST(o_orderdate AS DATE) AS route_date, 8 + o_orderkey % 10 AS hh,
  lpad(CAST(8 + o_orderkey % 10 AS VARCHAR), 2, '0') || ':' ||
    lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00' AS departure_time_utc,
  o_totalprice * 100 AS executor_capacity_cm3,
  CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' WHEN 'P' THEN 'Low' END
    AS route_score,
  CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 END AS route_score_numeric
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")

_cte("ks", "kr", """
SELECT rk, sk, route_id, 'S' || sk AS stop_id, station_code, route_date,
  40.0::DOUBLE + (sk * 37 % 1000) / 10000.0::DOUBLE AS lat,
  -73.0::DOUBLE - (sk * 91 % 1000) / 10000.0::DOUBLE AS lng, 'Dropoff' AS stop_type,
  CASE WHEN sk % 37 <> 0 THEN 'Z' || (sk % 20) END AS zone_id, 0 AS is_station,
  CAST(row_number() OVER (PARTITION BY rk ORDER BY first_day, sk) AS INT) AS position
FROM (SELECT l_orderkey AS rk, l_suppkey AS sk, CAST(min(l_shipdate) AS DATE) AS first_day
      FROM lineitem GROUP BY 1, 2) s JOIN kr USING (rk)
UNION ALL
SELECT rk, -1, route_id, 'DEPOT', station_code, route_date, 40.5::DOUBLE + nk / 100.0::DOUBLE,
  -73.5::DOUBLE, 'Station', NULL, 1, 0 FROM kr""")

_cte("packages_", "", """
SELECT 'R' || l_orderkey AS route_id, 'S' || l_suppkey AS stop_id,
  'P' || l_orderkey || '_' || l_suppkey || '_' || l_partkey || '_' || l_linenumber AS package_id,
  CASE l_returnflag WHEN 'N' THEN 'DELIVERED' WHEN 'A' THEN 'DELIVERY_ATTEMPTED'
    WHEN 'R' THEN 'REJECTED' END AS scan_status,
  CASE WHEN (l_partkey + l_linenumber) % 12 = 0
    THEN CAST(l_shipdate AS DATE) + INTERVAL 9 HOUR END AS time_window_start_utc,
  CASE WHEN (l_partkey + l_linenumber) % 12 = 0
    THEN CAST(l_shipdate AS DATE) + INTERVAL 13 HOUR END AS time_window_end_utc,
  CASE WHEN (l_partkey + l_linenumber) % 12 = 0 THEN 1 ELSE 0 END AS has_time_window,
  l_quantity * 3 AS planned_service_time_seconds,
  CASE WHEN l_partkey % 23 <> 0 THEN CAST(p_size AS DOUBLE) END AS depth_cm,
  10.0::DOUBLE + l_quantity / 5 AS height_cm, CAST(12 + l_linenumber AS DOUBLE) AS width_cm,
  CASE WHEN l_partkey % 23 <> 0 THEN CAST(p_size AS DOUBLE) END
    * (10.0::DOUBLE + l_quantity / 5) * CAST(12 + l_linenumber AS DOUBLE) AS volume_cm3
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")

_cte("seg", "ks", f"""
SELECT route_id, position AS segment_position, fstop AS from_stop_id, stop_id AS to_stop_id,
  CASE WHEN fsk <> -1 AND (sk * 7 + rk) % 101 = 0 THEN 0.0::DOUBLE
    ELSE round(CASE WHEN fsk = -1 THEN 600.0::DOUBLE + 12.0::DOUBLE * km
      ELSE 20.0::DOUBLE + 80.0::DOUBLE * km END + ((fsk + 1) * 31 + sk * 17) % 60, 3)
  END AS travel_time_seconds
FROM (SELECT *, {KM.format(a="f", b="")} AS km FROM (
  SELECT *, lag(sk) OVER w AS fsk, lag(stop_id) OVER w AS fstop, lag(lat) OVER w AS flat,
    lag(lng) OVER w AS flng FROM ks WINDOW w AS (PARTITION BY rk ORDER BY position)) a) b
WHERE fsk IS NOT NULL""")

_cte("wx", "kr", """
SELECT station_code, weather_date, 40.5::DOUBLE + nk / 100.0::DOUBLE AS station_lat,
  -73.5::DOUBLE AS station_lng, t + 4 AS temperature_2m_max_c, t - 4 AS temperature_2m_min_c,
  t AS temperature_2m_mean_c, t + 3 AS apparent_temperature_max_c,
  t - 5 AS apparent_temperature_min_c,
  r + CASE WHEN (d + nk) % 4 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS precipitation_sum_mm,
  r AS rain_sum_mm, 0.0::DOUBLE AS snowfall_sum_cm, CAST((d + nk) % 4 AS DOUBLE) AS weather_code,
  w AS wind_speed_10m_max_kmh, w * 1.5::DOUBLE AS wind_gusts_10m_max_kmh,
  'UTC' AS source_timezone, 'C' AS temperature_unit, 'mm' AS precipitation_unit,
  'km/h' AS wind_speed_unit
FROM (SELECT *, 10.0::DOUBLE + ((d * 7 + nk * 3) % 200) / 10.0::DOUBLE AS t,
    CASE WHEN (d + nk) % 3 = 0 THEN ((d * 5 + nk) % 90) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS r,
    5.0::DOUBLE + ((d * 11 + nk * 7) % 300) / 10.0::DOUBLE AS w
  FROM (SELECT DISTINCT station_code, route_date AS weather_date, nk,
          date_diff('day', DATE '1995-01-01', route_date) AS d FROM kr) a
  WHERE (d + nk) % 211 <> 0) b""")

_cte("hol", "kr", """
SELECT CAST(y || d AS DATE) AS holiday_date, name AS local_name, name, 'US' AS country_code,
  CASE WHEN d = '-07-04' THEN 0 ELSE 1 END AS is_fixed, 1 AS is_global,
  CASE WHEN d = '-07-04' THEN 'US-NY|US-NJ' ELSE '' END AS counties, 'Public|Bank' AS types
FROM (SELECT DISTINCT year(route_date) AS y FROM kr) a,
  (VALUES ('-01-01', 'New Year''s Day'), ('-07-04', 'Independence Day'),
    ('-12-25', 'Christmas Day')) h(d, name)""")

_cte("cal", "kr hol", """
SELECT d AS calendar_date, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month,
  CAST(day(d) AS INT) AS day, CAST(isodow(d) - 1 AS INT) AS weekday, dayname(d) AS weekday_name,
  CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN d IN (SELECT holiday_date FROM hol) THEN 1 ELSE 0 END AS is_us_public_holiday
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT min(route_date) AS lo, max(route_date) AS hi FROM kr) a) b""")

_cte("inv", "kr", """
SELECT route_id, (rk % 50) / 100.0::DOUBLE AS invalid_sequence_score FROM kr WHERE rk % 17 <> 0""")

_cte("rt", "kr ks", """
SELECT kr.route_id, kr.station_code, kr.route_date, departure_time_utc,
  CAST(CAST(kr.route_date AS VARCHAR) || ' ' || departure_time_utc AS TIMESTAMP)
    AS departure_timestamp_utc, executor_capacity_cm3, route_score, route_score_numeric,
  total_stops, dropoff_stops, station_stops, avg_stop_lat, avg_stop_lng
FROM kr JOIN (SELECT route_id, count(*) AS total_stops,
    count(*) FILTER (stop_type = 'Dropoff') AS dropoff_stops,
    count(*) FILTER (stop_type = 'Station') AS station_stops, avg(lat) AS avg_stop_lat,
    avg(lng) AS avg_stop_lng FROM ks GROUP BY 1) s USING (route_id)""")

_cte("stop_sum", "ks", """
SELECT route_id, count(*) AS stop_rows, count(DISTINCT zone_id) AS unique_zones,
  count(*) FILTER (stop_type = 'Station') AS station_stop_count,
  count(*) FILTER (stop_type = 'Dropoff') AS dropoff_stop_count,
  round(max(lat) - min(lat), 6) AS lat_range, round(max(lng) - min(lng), 6) AS lng_range
FROM ks GROUP BY 1""")

_cte("pack_sum", "packages_", """
SELECT route_id, count(*) AS package_count,
  count(*) FILTER (scan_status = 'DELIVERED') AS delivered_package_count,
  count(*) FILTER (scan_status = 'REJECTED') AS rejected_package_count,
  count(*) FILTER (scan_status = 'DELIVERY_ATTEMPTED') AS delivery_attempted_count,
  count(*) FILTER (scan_status IS NULL OR scan_status NOT IN
    ('DELIVERED', 'REJECTED', 'DELIVERY_ATTEMPTED')) AS other_scan_status_count,
  CAST(sum(has_time_window) AS BIGINT) AS packages_with_time_window,
  round(CAST(sum(has_time_window) AS DOUBLE) / count(*), 6) AS packages_with_time_window_ratio,
  sum(planned_service_time_seconds) AS total_planned_service_time_seconds,
  avg(planned_service_time_seconds) AS mean_planned_service_time_seconds,
  sum(volume_cm3) AS total_package_volume_cm3, avg(volume_cm3) AS mean_package_volume_cm3,
  max(volume_cm3) AS max_package_volume_cm3
FROM packages_ GROUP BY 1""")

_cte("seq_sum", "ks", """
SELECT route_id, count(*) AS sequence_stop_count, max(position) AS max_actual_sequence_position
FROM ks GROUP BY 1""")

_cte("dist", "ks", f"""
SELECT route_id, round(sum(km), 6) AS total_haversine_distance_km,
  round(sum(km) FILTER (ptype = 'Station'), 6) AS depot_to_first_stop_distance_km,
  round(sum(km) FILTER (ptype <> 'Station'), 6) AS delivery_haversine_distance_km,
  round(avg(km) FILTER (ptype <> 'Station'), 6) AS mean_delivery_segment_distance_km
FROM (SELECT *, {KM.format(a="f", b="")} AS km FROM (
  SELECT *, lag(stop_type) OVER w AS ptype, lag(lat) OVER w AS flat, lag(lng) OVER w AS flng
  FROM ks WINDOW w AS (PARTITION BY route_id ORDER BY position)) a) b GROUP BY 1""")

_cte("tt", "seg", """
SELECT route_id, round(sum(travel_time_seconds), 6) AS total_travel_time_seconds,
  count(*) AS travel_segment_count FROM seg GROUP BY 1""")

_cte("g_routes", "rt inv stop_sum pack_sum seq_sum dist tt wx cal", """
SELECT rt.route_id, rt.station_code, rt.route_date, departure_time_utc, departure_timestamp_utc,
  executor_capacity_cm3, route_score, route_score_numeric, invalid_sequence_score, total_stops,
  dropoff_stops, station_stops, stop_rows, unique_zones, lat_range, lng_range, package_count,
  delivered_package_count, rejected_package_count, delivery_attempted_count,
  other_scan_status_count, packages_with_time_window, packages_with_time_window_ratio,
  round(total_planned_service_time_seconds, 6) AS total_planned_service_time_seconds,
  round(mean_planned_service_time_seconds, 6) AS mean_planned_service_time_seconds,
  round(total_package_volume_cm3, 6) AS total_package_volume_cm3,
  round(mean_package_volume_cm3, 6) AS mean_package_volume_cm3,
  round(max_package_volume_cm3, 6) AS max_package_volume_cm3, sequence_stop_count,
  max_actual_sequence_position, total_haversine_distance_km, depot_to_first_stop_distance_km,
  delivery_haversine_distance_km, total_travel_time_seconds,
  round(total_travel_time_seconds + total_planned_service_time_seconds, 6)
    AS route_duration_seconds,
  CAST(round(CAST(CAST(round(total_travel_time_seconds + total_planned_service_time_seconds, 6)
    / 3600 AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) AS route_duration_hours,
  temperature_2m_max_c, temperature_2m_min_c, temperature_2m_mean_c, apparent_temperature_max_c,
  apparent_temperature_min_c, precipitation_sum_mm, rain_sum_mm, snowfall_sum_cm, weather_code,
  wind_speed_10m_max_kmh, wind_gusts_10m_max_kmh, year, month, day, weekday, weekday_name,
  is_weekend, is_us_public_holiday,
  CASE WHEN dropoff_stops > 0 THEN round(package_count / CAST(dropoff_stops AS DOUBLE), 6) END
    AS packages_per_dropoff_stop,
  CASE WHEN package_count > 0 THEN round(total_package_volume_cm3 / package_count, 6) END
    AS volume_per_package_cm3,
  CASE WHEN package_count > 0 THEN round(total_planned_service_time_seconds / package_count, 6)
    END AS planned_service_time_per_package_seconds,
  mean_delivery_segment_distance_km,
  CASE WHEN rain_sum_mm > 0 THEN 1 ELSE 0 END AS has_rain,
  CASE WHEN precipitation_sum_mm > 0 THEN 1 ELSE 0 END AS has_precipitation
FROM rt LEFT JOIN inv USING (route_id) LEFT JOIN stop_sum USING (route_id)
  LEFT JOIN pack_sum USING (route_id) LEFT JOIN seq_sum USING (route_id)
  LEFT JOIN dist USING (route_id) LEFT JOIN tt USING (route_id)
  LEFT JOIN wx ON rt.station_code = wx.station_code AND rt.route_date = wx.weather_date
  LEFT JOIN cal ON rt.route_date = cal.calendar_date""")

_cte("load", "packages_", """
SELECT route_id, stop_id, count(*) AS packages_at_destination,
  round(sum(planned_service_time_seconds), 3) AS service_time_at_destination_seconds,
  round(sum(volume_cm3), 3) AS volume_at_destination_cm3,
  CAST(sum(has_time_window) AS BIGINT) AS packages_with_window_at_destination
FROM packages_ GROUP BY 1, 2""")

_cte("g_seg", "seg ks load rt wx cal packages_", f"""
SELECT route_id, segment_position, from_stop_id, to_stop_id, travel_time_seconds, km
    AS segment_distance_km, is_depot_segment, from_zone_id, to_zone_id,
  CASE WHEN from_zone_id IS NULL OR to_zone_id IS NULL THEN NULL
    WHEN from_zone_id = to_zone_id THEN 1 ELSE 0 END AS same_zone,
  flat AS from_lat, flng AS from_lng, tlat AS to_lat, tlng AS to_lng,
  coalesce(packages_at_destination, 0) AS packages_at_destination,
  coalesce(service_time_at_destination_seconds, 0) AS service_time_at_destination_seconds,
  coalesce(volume_at_destination_cm3, 0) AS volume_at_destination_cm3,
  coalesce(packages_with_window_at_destination, 0) AS packages_with_window_at_destination,
  round(segment_position / CAST(total_stops - 1 AS DOUBLE), 6) AS segment_ratio,
  round(coalesce(sum(km) OVER (PARTITION BY route_id ORDER BY segment_position
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS cumulative_distance_km,
  station_code, route_date, departure_hour, total_stops AS route_total_stops,
  route_package_count, weekday, is_weekend, temperature_2m_mean_c, rain_sum_mm,
  CASE WHEN rain_sum_mm > 0 THEN 1 ELSE 0 END AS has_rain, wind_speed_10m_max_kmh
FROM (
  SELECT seg.*, o.lat AS flat, o.lng AS flng, o.zone_id AS from_zone_id,
    CASE WHEN o.stop_type = 'Station' THEN 1 ELSE 0 END AS is_depot_segment,
    d.lat AS tlat, d.lng AS tlng, d.zone_id AS to_zone_id,
    round({KM.format(a="o.", b="d.")}, 6) AS km
  FROM seg LEFT JOIN ks o ON seg.route_id = o.route_id AND seg.from_stop_id = o.stop_id
    LEFT JOIN ks d ON seg.route_id = d.route_id AND seg.to_stop_id = d.stop_id) s
  LEFT JOIN (SELECT route_id, stop_id AS to_stop_id, * EXCLUDE (route_id, stop_id) FROM load) l
    USING (route_id, to_stop_id)
  LEFT JOIN (SELECT route_id, station_code, route_date, total_stops,
      CAST(hour(departure_timestamp_utc) AS INT) AS departure_hour FROM rt) r USING (route_id)
  LEFT JOIN (SELECT station_code, weather_date AS route_date, temperature_2m_mean_c, rain_sum_mm,
      wind_speed_10m_max_kmh FROM wx) w USING (station_code, route_date)
  LEFT JOIN (SELECT calendar_date AS route_date, weekday, is_weekend FROM cal) c
    USING (route_date)
  LEFT JOIN (SELECT route_id, count(*) AS route_package_count FROM packages_ GROUP BY 1) p
    USING (route_id)""")


def half_up(x: str, digits: int) -> str:
    """Round the printed decimal, so that halves go up in both engines."""
    return (
        f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"
    )


_cte("rl", "g_seg", "SELECT DISTINCT route_id FROM g_seg")

_cte("split_", "rl", """
SELECT route_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || route_id)) <=
  greatest(1, CAST(floor(0.2::DOUBLE * (SELECT count(*) FROM rl)) AS BIGINT)) THEN 1 ELSE 0 END
  AS is_test FROM rl""")

MODEL = (
    "route_id, travel_time_seconds, is_depot_segment, segment_distance_km,"
    " coalesce(same_zone, 0) AS same_zone, segment_position, cumulative_distance_km,"
    " packages_at_destination, service_time_at_destination_seconds, volume_at_destination_cm3,"
    " packages_with_window_at_destination, departure_hour, route_total_stops,"
    " route_package_count, weekday, station_code, coalesce(to_zone_id, 'SIN_ZONA') AS to_zone_id"
)

_cte("mrows", "g_seg split_", f"SELECT {MODEL}, is_test FROM g_seg JOIN split_ USING (route_id)")

_cte("train", "mrows", "SELECT * EXCLUDE (is_test) FROM mrows WHERE is_test = 0")

_cte("folds", "train", """
SELECT route_id, segments, CAST(CASE WHEN (k - 1) % 10 < 5 THEN (k - 1) % 10 + 1
  ELSE 10 - (k - 1) % 10 END AS INT) AS fold
FROM (SELECT *, row_number() OVER (ORDER BY segments DESC, md5(route_id)) AS k
  FROM (SELECT route_id, count(*) AS segments FROM train GROUP BY 1) a) b""")

_cte("tf", "train folds", """
SELECT train.*, fold FROM train JOIN folds USING (route_id)""")


def coef_cte(rows: str) -> str:
    """Baseline parameters per (fold, population), trained on the other folds of ``rows``."""
    xy = "travel_time_seconds, segment_distance_km"
    return f"""
SELECT a.fold, p.is_depot_segment, mean, rate, slope_all, icpt_all, slope, icpt
FROM (SELECT f.fold, avg(travel_time_seconds) AS mean,
    sum(travel_time_seconds) / sum(segment_distance_km) AS rate, regr_slope({xy}) AS slope_all,
    regr_intercept({xy}) AS icpt_all
  FROM (SELECT DISTINCT fold FROM {rows}) f JOIN {rows} t ON t.fold <> f.fold GROUP BY 1) a
JOIN (SELECT f.fold, is_depot_segment, regr_slope({xy}) AS slope, regr_intercept({xy}) AS icpt
  FROM (SELECT DISTINCT fold FROM {rows}) f JOIN {rows} t ON t.fold <> f.fold GROUP BY 1, 2) p
  USING (fold)"""


PREDICT = (
    "mean AS B0, segment_distance_km * rate AS B1,"
    " greatest(0, slope_all * segment_distance_km + icpt_all) AS B2,"
    " greatest(0, slope * segment_distance_km + icpt) AS B3"
)

_cte("coef", "tf", coef_cte("tf"))

_cte("bp", "tf coef", f"""
SELECT tf.*, {PREDICT} FROM tf JOIN coef USING (fold, is_depot_segment)""")

_cte("oof_", "bp", """
SELECT route_id, station_code, segment_position, route_total_stops, departure_hour, weekday,
  same_zone, segment_distance_km, is_depot_segment, travel_time_seconds, fold, B3 AS prediction,
  travel_time_seconds - B3 AS residual FROM bp""")

_cte("line", "train", """
SELECT is_depot_segment, regr_slope(travel_time_seconds, segment_distance_km) AS slope,
  regr_intercept(travel_time_seconds, segment_distance_km) AS icpt FROM train GROUP BY 1""")

_cte("hold", "g_seg split_", """
SELECT g_seg.* FROM g_seg JOIN split_ USING (route_id) WHERE is_test = 1""")

_cte("scored", "hold line", """
SELECT hold.*, greatest(0, slope * segment_distance_km + icpt) AS prediction
FROM hold JOIN line USING (is_depot_segment)""")

_cte("profile", "train", """
SELECT station_code, segments, """ + ", ".join(
    f"[{', '.join(f'quantile_cont({c}, {p})' for p in (0.1, 0.25, 0.5, 0.75, 0.9))}] AS {c}"
    for c in ("packages_at_destination", "service_time_at_destination_seconds",
              "volume_at_destination_cm3", "packages_with_window_at_destination")
) + """, any_value(zones) AS zones_seen
FROM train JOIN (SELECT station_code, count(*) AS segments FROM train GROUP BY 1) n
    USING (station_code)
  LEFT JOIN (SELECT station_code, list(to_zone_id ORDER BY k) AS zones FROM (
      SELECT station_code, to_zone_id, row_number() OVER (PARTITION BY station_code
        ORDER BY count(*) DESC, to_zone_id) AS k FROM train GROUP BY 1, 2) a
    WHERE k <= 50 GROUP BY 1) z USING (station_code)
GROUP BY station_code, segments""")

_cte("depots", "g_seg split_", """
SELECT station_code, avg(from_lat) AS depot_lat, avg(from_lng) AS depot_lng
FROM g_seg JOIN split_ USING (route_id) WHERE is_depot_segment = 1 AND is_test = 0 GROUP BY 1""")

_cte("planned", "g_seg", """
SELECT route_id, station_code, segment_position AS position, to_stop_id AS stop_id, to_lat AS lat,
  to_lng AS lng, CASE WHEN n % 3 <> 0 THEN to_zone_id END AS to_zone_id, packages_at_destination,
  CASE WHEN n % 2 <> 0 THEN service_time_at_destination_seconds END AS service,
  CASE WHEN n % 2 <> 0 THEN volume_at_destination_cm3 END AS volume,
  CASE WHEN n % 2 <> 0 THEN CAST(packages_with_window_at_destination AS DOUBLE) END AS windowed,
  departure_hour, weekday
FROM (SELECT *, CAST(substr(to_stop_id, 2) AS BIGINT) AS n FROM g_seg) t""")


def pick(values: str, field: str) -> str:
    number = (f"CAST('0x' || substr(md5('7:' || route_id || ':' || stop_id || ':{field}'), 1, 6)"
              " AS BIGINT)")
    return f"{values}[{number} % len({values}) + 1]"


_cte("pfill", "planned profile depots", f"""
SELECT p.route_id, p.station_code, position, stop_id, lat, lng,
  coalesce(p.to_zone_id, {pick("zones_seen", "to_zone_id")}, 'SIN_ZONA') AS to_zone_id,
  p.packages_at_destination,
  coalesce(service, {pick("f.service_time_at_destination_seconds",
                          "service_time_at_destination_seconds")}) AS service,
  coalesce(volume, {pick("f.volume_at_destination_cm3", "volume_at_destination_cm3")}) AS volume,
  coalesce(windowed, {pick("f.packages_with_window_at_destination",
                           "packages_with_window_at_destination")}, 0) AS windowed,
  list_filter([CASE WHEN service IS NULL THEN 'service_time_at_destination_seconds' END,
    CASE WHEN volume IS NULL THEN 'volume_at_destination_cm3' END,
    CASE WHEN windowed IS NULL THEN 'packages_with_window_at_destination' END,
    CASE WHEN p.to_zone_id IS NULL THEN 'to_zone_id' END,
    CASE WHEN position = 1 AND depot_lat IS NULL THEN 'origin' END], lambda x: x IS NOT NULL)
    AS estimated_fields,
  coalesce(depot_lat, first_value(lat) OVER r) AS depot_lat,
  coalesce(depot_lng, first_value(lng) OVER r) AS depot_lng, departure_hour, weekday,
  count(*) OVER (PARTITION BY p.route_id) + 1 AS route_total_stops,
  CAST(sum(p.packages_at_destination) OVER (PARTITION BY p.route_id) AS BIGINT)
    AS route_package_count
FROM planned p LEFT JOIN profile f USING (station_code) LEFT JOIN depots d USING (station_code)
WINDOW r AS (PARTITION BY p.route_id ORDER BY position)""")

_cte("plegs", "pfill", f"""
SELECT *, round(coalesce(sum(km) OVER (PARTITION BY route_id ORDER BY position
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS cumulative_distance_km
FROM (SELECT *, round({KM.format(a="f", b="")}, 6) AS km,
    CASE WHEN from_zone IS NULL THEN NULL WHEN from_zone = to_zone_id THEN 1 ELSE 0 END
      AS same_zone
  FROM (SELECT *, coalesce(lag(stop_id) OVER r, 'DEPOT') AS from_stop_id,
      coalesce(lag(lat) OVER r, depot_lat) AS flat, coalesce(lag(lng) OVER r, depot_lng) AS flng,
      lag(to_zone_id) OVER r AS from_zone,
      CASE WHEN lag(stop_id) OVER r IS NULL THEN 1 ELSE 0 END AS is_depot_segment
    FROM pfill WINDOW r AS (PARTITION BY route_id ORDER BY position)) a) b""")


def sql(needs: str, select: str) -> str:
    """A select with the common tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0].split():
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    if not order:
        return select.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1].strip()})" for n in order)
    return f"WITH {head}\n{select.strip()}"
