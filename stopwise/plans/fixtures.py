"""Delivery tables derived by Spark from the order tables of a test-data folder.

An order is a route, its suppliers are the stops, its line items are the packages. Every column is
plain arithmetic on the given tables, so the same tables can be written in any SQL engine.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions import scalars
from stopwise.functions.dates import daily_calendar
from stopwise.functions.geo import haversine_km
from stopwise.operators.joins import by_route
from stopwise.operators.ordered import BLOCK_ROWS, along, dealt, fits_one_block, numbered


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (
        base(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")
    )
    rk, nk = F.col("o_orderkey"), F.col("c_nationkey")
    hour, minute = 8 + rk % 10, rk % 60
    time = F.format_string("%02d:%02d:00", hour, minute)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            rk.alias("rk"),
            nk.alias("nk"),
            F.concat(F.lit("R"), rk).alias("route_id"),
            F.concat(F.lit("D"), F.substring("r_name", 1, 2), nk).alias("station_code"),
            F.to_date("o_orderdate").alias("route_date"),
            time.alias("departure_time_utc"),
            (F.col("o_totalprice") * 100).alias("executor_capacity_cm3"),
            F.when(F.col("o_orderstatus") == "F", "High")
            .when(F.col("o_orderstatus") == "O", "Medium")
            .when(F.col("o_orderstatus") == "P", "Low")
            .alias("route_score"),
        )
    )


def keyed_stops(spark: SparkSession, sf_dir: str, routes: DataFrame) -> DataFrame:
    """Stops with their position; the depot is position 0."""
    line = base(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    # no route has more stops than lines
    lines_of = line.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    short = lines_of.filter(F.col("n") > BLOCK_ROWS).isEmpty()
    if short:
        line = dealt(line, "l_orderkey", (line,))  # the one dealing of what follows
    served = (
        line.groupBy(F.col("l_orderkey").alias("rk"), F.col("l_suppkey").alias("sk"))
        .agg(F.to_date(F.min("l_shipdate")).alias("first_day"))
        # the route's id is spelt out behind the joins, so that only its key moves
        .join(by_route(routes.select("rk", "station_code", "route_date")), "rk")
        .withColumn("route_id", F.concat(F.lit("R"), "rk"))
    )
    if short:
        order = F.struct("first_day", "sk")
        placed = numbered(served.withColumn("_o", order), ["rk"], ["_o"], "position").drop("_o")
    else:
        cut = served.withColumn("_piece", F.floor(F.col("sk") / BLOCK_ROWS))
        placed = numbered(cut, ["rk"], ["first_day", "_piece", "sk"], "position").drop("_piece")
    sk = F.col("sk")
    delivery = placed.select(
        "rk",
        "sk",
        "route_id",
        F.concat(F.lit("S"), sk).alias("stop_id"),
        "station_code",
        "route_date",
        (F.lit(40.0) + (sk * 37 % 1000) / 10000.0).alias("lat"),
        (F.lit(-73.0) - (sk * 91 % 1000) / 10000.0).alias("lng"),
        F.lit("Dropoff").alias("stop_type"),
        F.when(sk % 37 != 0, F.concat(F.lit("Z"), sk % 20)).alias("zone_id"),
        F.lit(0).alias("is_station"),
        F.col("position").cast("int").alias("position"),
    )
    depot = routes.select(
        "rk",
        F.lit(-1).cast("bigint").alias("sk"),
        "route_id",
        F.lit("DEPOT").alias("stop_id"),
        "station_code",
        "route_date",
        (F.lit(40.5) + F.col("nk") / 100.0).alias("lat"),
        F.lit(-73.5).alias("lng"),
        F.lit("Station").alias("stop_type"),
        F.lit(None).cast("string").alias("zone_id"),
        F.lit(1).alias("is_station"),
        F.lit(0).alias("position"),
    )
    return delivery.unionByName(depot)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = base(spark, sf_dir, "lineitem"), base(spark, sf_dir, "part")
    orders = base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    pk, ln = F.col("l_partkey"), F.col("l_linenumber")
    window = (pk + ln) % 12 == 0
    day = F.to_date("l_shipdate")
    depth = F.when(pk % 23 != 0, F.col("p_size").cast("double"))
    height, width = F.lit(10.0) + F.col("l_quantity") / 5, (12 + ln).cast("double")
    key = F.concat_ws("_", F.concat(F.lit("P"), "l_orderkey"), "l_suppkey", "l_partkey", ln)
    status = (
        F.when(F.col("l_returnflag") == "N", "DELIVERED")
        .when(F.col("l_returnflag") == "A", "DELIVERY_ATTEMPTED")
        .when(F.col("l_returnflag") == "R", "REJECTED")
    )
    out = (
        line.join(by_route(orders), "l_orderkey")
        .join(part, pk == F.col("p_partkey"))
        .select(
            F.concat(F.lit("R"), "l_orderkey").alias("route_id"),
            F.concat(F.lit("S"), "l_suppkey").alias("stop_id"),
            key.alias("package_id"),
            status.alias("scan_status"),
            F.when(window, F.to_timestamp(day) + F.expr("interval 9 hours")).alias(
                "time_window_start_utc"
            ),
            F.when(window, F.to_timestamp(day) + F.expr("interval 13 hours")).alias(
                "time_window_end_utc"
            ),
            F.when(window, 1).otherwise(0).alias("has_time_window"),
            (F.col("l_quantity") * 3).alias("planned_service_time_seconds"),
            depth.alias("depth_cm"),
            height.alias("height_cm"),
            width.alias("width_cm"),
            scalars.package_volume(depth, height, width).alias("volume_cm3"),
        )
    )
    return scalars.conform(out, schemas.PACKAGES)


def segments(stops: DataFrame) -> DataFrame:
    """Driving seconds between neighbours on the walked order."""
    def stop_id(key: str) -> Column:
        return F.when(F.col(key) == -1, "DEPOT").otherwise(F.concat(F.lit("S"), key))

    # ids are spelt out behind the window, so that only keys move
    keys = stops.select("rk", "sk", "lat", "lng", "position")
    walked = along(
        dealt(keys, "rk", (stops,)) if fits_one_block(stops, "position") else keys,
        ["rk"],
        "position",
        previous={"fsk": "sk", "flat": "lat", "flng": "lng"},
        extent=stops,
    ).filter("fsk IS NOT NULL")
    walked = walked.withColumns(
        {"route_id": F.concat(F.lit("R"), "rk"), "from_stop_id": stop_id("fsk"), "stop_id": stop_id("sk")}
    )
    km = haversine_km(F.col("flat"), F.col("flng"), F.col("lat"), F.col("lng"))
    depot = F.col("fsk") == -1
    drive = F.when(depot, 600.0 + 12.0 * km).otherwise(20.0 + 80.0 * km)
    seconds = F.round(drive + ((F.col("fsk") + 1) * 31 + F.col("sk") * 17) % 60, 3)
    stuck = ~depot & ((F.col("sk") * 7 + F.col("rk")) % 101 == 0)
    return scalars.conform(
        walked.select(
            "route_id",
            F.col("position").alias("segment_position"),
            "from_stop_id",
            F.col("stop_id").alias("to_stop_id"),
            F.when(stuck, 0.0).otherwise(seconds).alias("travel_time_seconds"),
        ),
        schemas.SEGMENTS,
    )


def weather(routes: DataFrame) -> DataFrame:
    d = F.datediff("route_date", F.lit("1995-01-01").cast("date"))
    nk = F.col("nk")
    temp = F.lit(10.0) + (d * 7 + nk * 3) % 200 / 10
    rain = F.when((d + nk) % 3 == 0, (d * 5 + nk) % 90 / 10).otherwise(0.0)
    wind = F.lit(5.0) + (d * 11 + nk * 7) % 300 / 10
    return scalars.conform(
        routes.select("station_code", "route_date", "nk")
        .distinct()
        .filter((d + nk) % 211 != 0)
        .select(
            "station_code",
            F.col("route_date").alias("weather_date"),
            (F.lit(40.5) + nk / 100.0).alias("station_lat"),
            F.lit(-73.5).alias("station_lng"),
            (temp + 4).alias("temperature_2m_max_c"),
            (temp - 4).alias("temperature_2m_min_c"),
            temp.alias("temperature_2m_mean_c"),
            (temp + 3).alias("apparent_temperature_max_c"),
            (temp - 5).alias("apparent_temperature_min_c"),
            (rain + F.when((d + nk) % 4 == 0, 0.5).otherwise(0.0)).alias("precipitation_sum_mm"),
            rain.alias("rain_sum_mm"),
            F.lit(0.0).alias("snowfall_sum_cm"),
            ((d + nk) % 4).alias("weather_code"),
            wind.alias("wind_speed_10m_max_kmh"),
            (wind * 1.5).alias("wind_gusts_10m_max_kmh"),
            F.lit("UTC").alias("source_timezone"),
            F.lit("C").alias("temperature_unit"),
            F.lit("mm").alias("precipitation_unit"),
            F.lit("km/h").alias("wind_speed_unit"),
        ),
        schemas.WEATHER,
    )


def holidays(routes: DataFrame) -> DataFrame:
    """Three fixed holidays for every year that has a route."""
    days = F.array(
        F.struct(F.lit("-01-01").alias("d"), F.lit("New Year's Day").alias("name")),
        F.struct(F.lit("-07-04").alias("d"), F.lit("Independence Day").alias("name")),
        F.struct(F.lit("-12-25").alias("d"), F.lit("Christmas Day").alias("name")),
    )
    return scalars.conform(
        routes.select(F.year("route_date").alias("y"))
        .distinct()
        .select("y", F.inline(days))
        .select(
            F.to_date(F.concat("y", "d")).alias("holiday_date"),
            F.col("name").alias("local_name"),
            "name",
            F.lit("US").alias("country_code"),
            F.when(F.col("d") == "-07-04", 0).otherwise(1).alias("is_fixed"),
            F.lit(1).alias("is_global"),
            F.when(F.col("d") == "-07-04", "US-NY|US-NJ").otherwise("").alias("counties"),
            F.lit("Public|Bank").alias("types"),
        ),
        schemas.HOLIDAYS,
    )


def silver_routes(routes: DataFrame, stops: DataFrame) -> DataFrame:
    own = stops.select("rk", "stop_type", "lat", "lng")
    if fits_one_block(stops, "position"):
        # whole routes meet before they are counted, so that no reading task holds a sum for each route
        own = dealt(own, "rk", (stops,))
    counts = own.groupBy("rk").agg(
        F.count("*").alias("total_stops"),
        F.count_if(F.col("stop_type") == "Dropoff").alias("dropoff_stops"),
        F.count_if(F.col("stop_type") == "Station").alias("station_stops"),
        F.avg("lat").alias("avg_stop_lat"),
        F.avg("lng").alias("avg_stop_lng"),
    )
    return scalars.conform(
        routes.join(by_route(counts), "rk", "left").withColumns(
            {
                "departure_timestamp_utc": scalars.departure_timestamp(
                    F.col("route_date"), F.col("departure_time_utc")
                ),
                "route_score_numeric": scalars.score_to_numeric(F.col("route_score")),
            }
        ),
        schemas.ROUTES,
    )


def invalid_scores(routes: DataFrame) -> DataFrame:
    rk = F.col("rk")
    return scalars.conform(
        routes.filter(rk % 17 != 0).select(
            "route_id", (rk % 50 / 100.0).alias("invalid_sequence_score")
        ),
        schemas.INVALID_SCORES,
    )


def build(spark: SparkSession, sf_dir: str, name: str, get) -> DataFrame:
    """``get`` returns an already written table by name."""
    if name == "keyed_routes":
        return keyed_routes(spark, sf_dir)
    if name == "keyed_stops":
        return keyed_stops(spark, sf_dir, get("keyed_routes"))
    if name == "routes":
        return silver_routes(get("keyed_routes"), get("keyed_stops"))
    if name == "stops":
        return scalars.conform(get("keyed_stops"), schemas.STOPS)
    if name == "sequences":
        return scalars.conform(
            get("keyed_stops").withColumnRenamed("position", "actual_sequence_position"),
            schemas.SEQUENCES,
        )
    if name == "packages":
        return packages(spark, sf_dir)
    if name == "segments":
        return segments(get("keyed_stops"))
    if name == "weather":
        return weather(get("keyed_routes"))
    if name == "holidays":
        return holidays(get("keyed_routes"))
    if name == "calendar":
        return scalars.conform(
            daily_calendar(get("keyed_routes"), get("holidays")), schemas.CALENDAR
        )
    if name == "invalid_scores":
        return invalid_scores(get("keyed_routes"))
    raise KeyError(name)
