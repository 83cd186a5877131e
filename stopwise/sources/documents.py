"""Raw documents to tables.

A document is JSON text keyed by route: one object for everything, or lines with an object each that
holds one route, several, or part of one (some of its stops or packages). Files of both kinds are
read in ranges as lines of the second kind, so that no task has to hold a whole file or route.
Weather and holidays come as one small object a file or a line.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions import scalars
from stopwise.functions.scalars import number_or_null, text_or_null
from stopwise.sources.json_ranges import small_objects

# Field names of the raw documents.
ROUTE_DOC = (
    "map<string, struct<station_code: string, date_YYYY_MM_DD: string, departure_time_utc: string,"
    " executor_capacity_cm3: double, route_score: string, stops: map<string,"
    " struct<lat: double, lng: double, type: string, zone_id: string>>>>"
)
PACKAGE_DOC = (
    "map<string, map<string, map<string, struct<scan_status: string,"
    " planned_service_time_seconds: double,"
    " dimensions: struct<depth_cm: double, height_cm: double, width_cm: double>,"
    " time_window: struct<start_time_utc: string, end_time_utc: string>>>>>"
)
SEQUENCE_DOC = "map<string, struct<actual: map<string, int>>>"
SCORE_DOC = "map<string, double>"
MATRIX_DOC = "map<string, map<string, map<string, double>>>"
DAILY = {
    "temperature_2m_max": "temperature_2m_max_c",
    "temperature_2m_min": "temperature_2m_min_c",
    "temperature_2m_mean": "temperature_2m_mean_c",
    "apparent_temperature_max": "apparent_temperature_max_c",
    "apparent_temperature_min": "apparent_temperature_min_c",
    "precipitation_sum": "precipitation_sum_mm",
    "rain_sum": "rain_sum_mm",
    "snowfall_sum": "snowfall_sum_cm",
    "weather_code": "weather_code",
    "wind_speed_10m_max": "wind_speed_10m_max_kmh",
    "wind_gusts_10m_max": "wind_gusts_10m_max_kmh",
}
WEATHER_DOC = (
    "struct<station: struct<station_code: string, latitude: double, longitude: double>,"
    " raw_response: struct<timezone: string, daily: struct<time: array<string>, "
    + ", ".join(f"{k}: array<double>" for k in DAILY)
    + ">, daily_units: map<string, string>>>"
)
HOLIDAY_DOC = (
    "struct<raw_response: array<struct<date: string, localName: string, name: string,"
    " countryCode: string, fixed: boolean, global: boolean, counties: array<string>,"
    " types: array<string>>>>"
)
# End of fixed values.


def lines(spark: SparkSession, path: str | list[str], wholetext: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=wholetext)


def _entries(docs: DataFrame, schema: str, key: str, value: str) -> DataFrame:
    return docs.select(F.explode(F.from_json("value", schema)).alias(key, value))


def _parsed_routes(docs: DataFrame) -> DataFrame:
    """One row per route and line, with the attributes repeated on each line of the route."""
    r = _entries(docs, ROUTE_DOC, "route_id", "r")
    return r.select(
        "route_id",
        F.col("r.station_code").alias("station_code"),
        F.to_date("r.date_YYYY_MM_DD").alias("route_date"),
        F.col("r.departure_time_utc").alias("departure_time_utc"),
        number_or_null(F.col("r.executor_capacity_cm3")).alias("executor_capacity_cm3"),
        F.col("r.route_score").alias("route_score"),
        F.col("r.stops").alias("stops"),
    )


def parse_routes(docs: DataFrame) -> DataFrame:
    """Route attributes with stop counts and mean coordinates. Each line is reduced to counts and
    sums before the shuffle, so stops never travel."""
    stops = F.map_values("stops")

    def total(field: str) -> Column:
        numbers = F.filter(
            F.transform(stops, lambda s: number_or_null(s[field])), lambda v: v.isNotNull()
        )
        return F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v), F.size(numbers)

    def kind(name: str) -> Column:
        return F.size(F.filter(stops, lambda s: s["type"] == name))

    (lat, n_lat), (lng, n_lng) = total("lat"), total("lng")
    facts = {
        "_stops": F.coalesce(F.size("stops"), F.lit(0)),
        "_drop": kind("Dropoff"),
        "_stat": kind("Station"),
        "_lat": lat,
        "_nlat": n_lat,
        "_lng": lng,
        "_nlng": n_lng,
    }
    attrs = [f.name for f in schemas.ROUTES][:4] + ["executor_capacity_cm3", "route_score"]
    attrs = [a for a in attrs if a != "route_id"]
    merged = (
        _parsed_routes(docs)
        .withColumns(facts)
        .groupBy("route_id")
        .agg(*[F.max(a).alias(a) for a in attrs], *[F.sum(f).alias(f) for f in facts])
    )
    ts = scalars.departure_timestamp(F.col("route_date"), F.col("departure_time_utc"))
    return scalars.conform(
        merged.withColumns(
            {
                "departure_timestamp_utc": ts,
                "departure_time_utc": scalars.time_text(ts),
                "route_score_numeric": scalars.score_to_numeric(F.col("route_score")),
                "total_stops": F.col("_stops"),
                "dropoff_stops": F.col("_drop"),
                "station_stops": F.col("_stat"),
                "avg_stop_lat": F.when(F.col("_nlat") > 0, F.col("_lat") / F.col("_nlat")),
                "avg_stop_lng": F.when(F.col("_nlng") > 0, F.col("_lng") / F.col("_nlng")),
            }
        ),
        schemas.ROUTES,
    )


def parse_stops(docs: DataFrame) -> DataFrame:
    parsed = _parsed_routes(docs)
    s = parsed.select("route_id", "station_code", "route_date", F.explode("stops").alias("stop_id", "s"))
    # a line that begins within a route has none of its attributes; there are few of these
    bare = F.col("station_code").isNull() & F.col("route_date").isNull()
    known = parsed.where(~bare).groupBy("route_id").agg(
        F.max("station_code").alias("station_code"), F.max("route_date").alias("route_date")
    )
    rest = s.where(bare).drop("station_code", "route_date").join(known, "route_id", "left")
    s = s.where(~bare).unionByName(rest)
    return scalars.conform(
        s.select(
            "*",
            number_or_null(F.col("s.lat")).alias("lat"),
            number_or_null(F.col("s.lng")).alias("lng"),
            F.col("s.type").alias("stop_type"),
            text_or_null(F.col("s.zone_id")).alias("zone_id"),
            scalars.station_flag(F.col("s.type")).alias("is_station"),
        ),
        schemas.STOPS,
    )


def parse_packages(docs: DataFrame) -> DataFrame:
    p = (
        _entries(docs, PACKAGE_DOC, "route_id", "r")
        .select("route_id", F.explode("r").alias("stop_id", "s"))
        .select("route_id", "stop_id", F.explode("s").alias("package_id", "p"))
        .select(
            "route_id",
            "stop_id",
            "package_id",
            F.col("p.scan_status").alias("scan_status"),
            text_or_null(F.col("p.time_window.start_time_utc")).alias("start"),
            text_or_null(F.col("p.time_window.end_time_utc")).alias("end"),
            number_or_null(F.col("p.planned_service_time_seconds")).alias(
                "planned_service_time_seconds"
            ),
            *[
                number_or_null(F.col(f"p.dimensions.{c}")).alias(c)
                for c in ("depth_cm", "height_cm", "width_cm")
            ],
        )
    )
    return scalars.conform(
        p.withColumns(
            {
                "time_window_start_utc": F.try_to_timestamp("start"),
                "time_window_end_utc": F.try_to_timestamp("end"),
                "has_time_window": scalars.time_window_flag(F.col("start"), F.col("end")),
                "volume_cm3": scalars.package_volume(
                    F.col("depth_cm"), F.col("height_cm"), F.col("width_cm")
                ),
            }
        ),
        schemas.PACKAGES,
    )


def parse_sequences(docs: DataFrame) -> DataFrame:
    return scalars.conform(
        _entries(docs, SEQUENCE_DOC, "route_id", "r").select(
            "route_id", F.explode("r.actual").alias("stop_id", "actual_sequence_position")
        ),
        schemas.SEQUENCES,
    )


def parse_invalid_scores(docs: DataFrame) -> DataFrame:
    return _entries(docs, SCORE_DOC, "route_id", "invalid_sequence_score")


def parse_matrix_rows(docs: DataFrame) -> DataFrame:
    """One row per route and origin, with the seconds to every destination still in a map."""
    return _entries(docs, MATRIX_DOC, "route_id", "m").select(
        "route_id", F.explode("m").alias("from_stop_id", "seconds_to")
    )


def parse_travel_matrix(docs: DataFrame) -> DataFrame:
    """The matrix as a table of cells, for matrices that are wanted whole."""
    return parse_matrix_rows(docs).select(
        "route_id", "from_stop_id", F.explode("seconds_to").alias("to_stop_id", "travel_time_seconds")
    )


def parse_weather(docs: DataFrame) -> DataFrame:
    d = docs.select(F.from_json("value", WEATHER_DOC).alias("d"))
    daily = F.arrays_zip("d.raw_response.daily.time", *[f"d.raw_response.daily.{k}" for k in DAILY])
    day = d.select("d", F.explode(daily).alias("x"))
    unit = F.col("d.raw_response.daily_units")
    return scalars.conform(
        day.select(
            F.col("d.station.station_code").alias("station_code"),
            F.to_date("x.time").alias("weather_date"),
            F.col("d.station.latitude").alias("station_lat"),
            F.col("d.station.longitude").alias("station_lng"),
            *[number_or_null(F.col(f"x.{k}")).alias(v) for k, v in DAILY.items()],
            F.col("d.raw_response.timezone").alias("source_timezone"),
            F.try_element_at(unit, F.lit("temperature_2m_mean")).alias("temperature_unit"),
            F.try_element_at(unit, F.lit("precipitation_sum")).alias("precipitation_unit"),
            F.try_element_at(unit, F.lit("wind_speed_10m_max")).alias("wind_speed_unit"),
        ),
        schemas.WEATHER,
    )


def parse_holidays(docs: DataFrame) -> DataFrame:
    h = docs.select(F.explode(F.from_json("value", HOLIDAY_DOC)["raw_response"]).alias("h"))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"h.{name}").cast("int"), F.lit(0))

    return scalars.conform(
        h.select(
            F.to_date("h.date").alias("holiday_date"),
            F.col("h.localName").alias("local_name"),
            F.col("h.name").alias("name"),
            F.col("h.countryCode").alias("country_code"),
            flag("fixed").alias("is_fixed"),
            flag("global").alias("is_global"),
            scalars.join_list(F.col("h.counties")).alias("counties"),
            scalars.join_list(F.col("h.types")).alias("types"),
        ),
        schemas.HOLIDAYS,
    )


def read_routes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_routes(small_objects(spark, path))


def read_stops(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_stops(small_objects(spark, path))


def read_packages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_packages(small_objects(spark, path))


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sequences(small_objects(spark, path))


def read_invalid_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_invalid_scores(small_objects(spark, path))


def read_matrix_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_matrix_rows(small_objects(spark, path))


def read_travel_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_travel_matrix(small_objects(spark, path))


def read_weather(spark: SparkSession, path: str | list[str], wholetext: bool = True) -> DataFrame:
    return parse_weather(lines(spark, path, wholetext))


def read_holidays(spark: SparkSession, path: str | list[str], wholetext: bool = True) -> DataFrame:
    return parse_holidays(lines(spark, path, wholetext))
