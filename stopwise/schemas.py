"""Table contracts: every table has one explicit, ordered schema; nothing is inferred."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _table(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs; unlike ``fromDDL`` it needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


# ---- Fixed values: column names, order and types of the published tables ----

ROUTES = _table(
    "route_id string, station_code string, route_date date, departure_time_utc string,"
    " departure_timestamp_utc timestamp, executor_capacity_cm3 double, route_score string,"
    " route_score_numeric int, total_stops bigint, dropoff_stops bigint, station_stops bigint,"
    " avg_stop_lat double, avg_stop_lng double"
)
STOPS = _table(
    "route_id string, stop_id string, station_code string, route_date date, lat double, lng double,"
    " stop_type string, zone_id string, is_station int"
)
PACKAGES = _table(
    "route_id string, stop_id string, package_id string, scan_status string,"
    " time_window_start_utc timestamp, time_window_end_utc timestamp, has_time_window int,"
    " planned_service_time_seconds double, depth_cm double, height_cm double, width_cm double,"
    " volume_cm3 double"
)
SEQUENCES = _table("route_id string, stop_id string, actual_sequence_position int")
INVALID_SCORES = _table("route_id string, invalid_sequence_score double")
STATIONS = _table(
    "station_code string, station_lat double, station_lng double, routes_with_station_point bigint"
)
SEGMENTS = _table(
    "route_id string, segment_position int, from_stop_id string, to_stop_id string,"
    " travel_time_seconds double"
)
WEATHER = _table(
    "station_code string, weather_date date, station_lat double, station_lng double,"
    " temperature_2m_max_c double, temperature_2m_min_c double, temperature_2m_mean_c double,"
    " apparent_temperature_max_c double, apparent_temperature_min_c double,"
    " precipitation_sum_mm double, rain_sum_mm double, snowfall_sum_cm double,"
    " weather_code double, wind_speed_10m_max_kmh double, wind_gusts_10m_max_kmh double,"
    " source_timezone string, temperature_unit string, precipitation_unit string,"
    " wind_speed_unit string"
)
HOLIDAYS = _table(
    "holiday_date date, local_name string, name string, country_code string, is_fixed int,"
    " is_global int, counties string, types string"
)
CALENDAR = _table(
    "calendar_date date, year int, month int, day int, weekday int, weekday_name string,"
    " is_weekend int, is_us_public_holiday int"
)
GOLD_ROUTES = _table(
    "route_id string, station_code string, route_date date, departure_time_utc string,"
    " departure_timestamp_utc timestamp, executor_capacity_cm3 double, route_score string,"
    " route_score_numeric int, invalid_sequence_score double, total_stops bigint,"
    " dropoff_stops bigint, station_stops bigint, stop_rows bigint, unique_zones bigint,"
    " lat_range double, lng_range double, package_count bigint, delivered_package_count bigint,"
    " rejected_package_count bigint, delivery_attempted_count bigint,"
    " other_scan_status_count bigint, packages_with_time_window bigint,"
    " packages_with_time_window_ratio double, total_planned_service_time_seconds double,"
    " mean_planned_service_time_seconds double, total_package_volume_cm3 double,"
    " mean_package_volume_cm3 double, max_package_volume_cm3 double, sequence_stop_count bigint,"
    " max_actual_sequence_position int, total_haversine_distance_km double,"
    " depot_to_first_stop_distance_km double, delivery_haversine_distance_km double,"
    " total_travel_time_seconds double, route_duration_seconds double,"
    " route_duration_hours double, temperature_2m_max_c double, temperature_2m_min_c double,"
    " temperature_2m_mean_c double, apparent_temperature_max_c double,"
    " apparent_temperature_min_c double, precipitation_sum_mm double, rain_sum_mm double,"
    " snowfall_sum_cm double, weather_code double, wind_speed_10m_max_kmh double,"
    " wind_gusts_10m_max_kmh double, year int, month int, day int, weekday int,"
    " weekday_name string, is_weekend int, is_us_public_holiday int,"
    " packages_per_dropoff_stop double, volume_per_package_cm3 double,"
    " planned_service_time_per_package_seconds double, mean_delivery_segment_distance_km double,"
    " has_rain int, has_precipitation int"
)
GOLD_SEGMENTS = _table(
    "route_id string, segment_position int, from_stop_id string, to_stop_id string,"
    " travel_time_seconds double, segment_distance_km double, is_depot_segment int,"
    " from_zone_id string, to_zone_id string, same_zone int, from_lat double, from_lng double,"
    " to_lat double, to_lng double, packages_at_destination bigint,"
    " service_time_at_destination_seconds double, volume_at_destination_cm3 double,"
    " packages_with_window_at_destination bigint, segment_ratio double,"
    " cumulative_distance_km double, station_code string, route_date date, departure_hour int,"
    " route_total_stops bigint, route_package_count bigint, weekday int, is_weekend int,"
    " temperature_2m_mean_c double, rain_sum_mm double, has_rain int,"
    " wind_speed_10m_max_kmh double"
)

TARGET = "travel_time_seconds"
NO_ZONE = "SIN_ZONA"
DELIVERY_NUMERIC = [
    "segment_distance_km",
    "same_zone",
    "segment_position",
    "cumulative_distance_km",
    "packages_at_destination",
    "service_time_at_destination_seconds",
    "volume_at_destination_cm3",
    "packages_with_window_at_destination",
    "departure_hour",
    "route_total_stops",
    "route_package_count",
    "weekday",
]
DEPOT_NUMERIC = [
    "segment_distance_km",
    "packages_at_destination",
    "service_time_at_destination_seconds",
    "volume_at_destination_cm3",
    "packages_with_window_at_destination",
    "departure_hour",
    "route_total_stops",
    "route_package_count",
    "weekday",
]
DELIVERY_FEATURES = [*DELIVERY_NUMERIC, "station_code", "to_zone_id"]
DEPOT_FEATURES = [*DEPOT_NUMERIC, "station_code"]
LOAD_COLUMNS = [
    "packages_at_destination",
    "service_time_at_destination_seconds",
    "volume_at_destination_cm3",
    "packages_with_window_at_destination",
]
ROUTE_OUTCOME_COLUMNS = [
    "total_travel_time_seconds",
    "route_duration_seconds",
    "route_duration_hours",
    "mean_delivery_segment_distance_km",
    "delivery_attempted_count",
    "route_score",
    "route_score_numeric",
    "invalid_sequence_score",
]

# ---- End of fixed values ----

IDENTIFIERS = ["route_id", "from_stop_id", "to_stop_id", "from_lat", "from_lng", "to_lat", "to_lng"]
SEGMENT_NUMERIC = [
    f.name
    for f in GOLD_SEGMENTS
    if isinstance(f.dataType, T.NumericType) and f.name not in IDENTIFIERS
]
ROUTE_NUMERIC = [f.name for f in GOLD_ROUTES if isinstance(f.dataType, T.NumericType)]
MODEL_COLUMNS = sorted(
    {"route_id", TARGET, "is_depot_segment", *DELIVERY_FEATURES, *DEPOT_FEATURES}
)
