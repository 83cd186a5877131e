"""The two published tables: one row per route and one row per segment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise import schemas
from stopwise.functions import scalars
from stopwise.functions.geo import haversine_km
from stopwise.operators import joins, stops as st
from stopwise.operators.ordered import along, block_of, dealt, fits_one_block, in_waves

ROUTE_WEATHER = [f.name for f in schemas.WEATHER][4:15]
ROUTE_CALENDAR = [f.name for f in schemas.CALENDAR][1:]


def assemble_route_table(routes: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """Routes left-joined with route-grain tables. All sides hash on ``route_id`` and have one row
    per route, so each side moves once and no key is hot."""
    out = routes
    for a in aggregates:
        out = out.join(joins.by_route(a), "route_id", "left")
    return out


def route_duration(df: DataFrame) -> DataFrame:
    total = F.col("total_travel_time_seconds") + F.col("total_planned_service_time_seconds")
    return df.withColumn("route_duration_seconds", F.round(total, 6)).withColumn(
        "route_duration_hours", F.round(F.col("route_duration_seconds") / 3600, 6)
    )


def gold_routes(
    routes: DataFrame,
    invalid_scores: DataFrame,
    stops: DataFrame,
    packages: DataFrame,
    sequences: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
    segments: DataFrame | None = None,
) -> DataFrame:
    own_stops, own_packages, read = stops, packages, (stops, sequences, packages)
    if fits_one_block(sequences, "actual_sequence_position"):
        # stops and packages move once, by route, to the same tasks: zones, stops and routes are summed there
        own_stops, own_packages = (dealt(t.where("route_id IS NOT NULL"), "route_id", read) for t in (stops, packages))
    joined = assemble_route_table(
        routes,
        invalid_scores,
        st.route_stop_summary(own_stops),
        st.route_package_summary(own_packages),
        st.route_sequence_summary(sequences),
        st.route_distance_split(stops, sequences, read),
    )
    joined = joins.optional_join(
        joined,
        None if segments is None else st.route_travel_time(segments),
        ["route_id"],
        T.StructType.fromDDL("total_travel_time_seconds double"),
    )
    joined = joins.with_weather(joined, weather, ROUTE_WEATHER)
    joined = joins.with_calendar(joined, calendar, ROUTE_CALENDAR)
    n, service = F.col("package_count"), F.col("total_planned_service_time_seconds")
    rounded = [
        "total_planned_service_time_seconds",
        "mean_planned_service_time_seconds",
        "total_package_volume_cm3",
        "mean_package_volume_cm3",
        "max_package_volume_cm3",
    ]
    derived = route_duration(joined).withColumns(
        {
            "packages_per_dropoff_stop": scalars.safe_ratio(n, F.col("dropoff_stops")),
            "volume_per_package_cm3": scalars.safe_ratio(F.col("total_package_volume_cm3"), n),
            "planned_service_time_per_package_seconds": scalars.safe_ratio(service, n),
            "has_rain": scalars.rain_flag(F.col("rain_sum_mm")),
            "has_precipitation": scalars.rain_flag(F.col("precipitation_sum_mm")),
        }
    )
    return scalars.conform(
        derived.withColumns({c: F.round(c, 6) for c in rounded}), schemas.GOLD_ROUTES
    )


ENDS = {"from": "origin", "to": "target.at"}


def with_stop_roles(segments: DataFrame, stops: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Segments with coordinates, zone and kind of the stops at their ends, and with the load of the
    stop they lead to where packages are given. A stop without packages has load 0."""
    ends = st.with_ends(segments, stops, packages)
    new = {f"{side}_{c}": F.col(f"{end}.{c}") for side, end in ENDS.items() for c in ("lat", "lng", "zone_id", "stop_type")}
    if packages is not None:
        new |= {c: F.coalesce(F.col(f"target.load.{c}"), F.lit(0)) for c in schemas.LOAD_COLUMNS}
    return ends.withColumns(new).drop("origin", "target")


def route_context(
    routes: DataFrame, packages: DataFrame, weather: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Everything a segment inherits from its route, at one row per route."""
    base = routes.select(
        "route_id",
        "station_code",
        "route_date",
        scalars.departure_hour(F.col("departure_timestamp_utc")).alias("departure_hour"),
        F.col("total_stops").alias("route_total_stops"),
    ).join(joins.by_route(st.route_package_count(packages)), "route_id", "left")
    base = joins.with_weather(
        base, weather, ["temperature_2m_mean_c", "rain_sum_mm", "wind_speed_10m_max_kmh"]
    )
    return joins.with_calendar(base, calendar, ["weekday", "is_weekend"])


def with_route_context(
    segments: DataFrame, context: DataFrame, extent: DataFrame | None = None
) -> DataFrame:
    """Left join on the route. A route longer than one block is spread over its blocks on both
    sides, so no task receives a whole giant route."""
    extent = segments if extent is None else extent
    if fits_one_block(extent, "segment_position"):
        return segments.join(joins.by_route(context), "route_id", "left")
    blocks = extent.select("route_id", block_of(F.col("segment_position")).alias("_block"))
    spread = context.join(joins.by_route(blocks.distinct()), "route_id", "left")
    return (
        segments.withColumn("_block", block_of(F.col("segment_position")))
        .join(joins.by_route(spread), ["route_id", "_block"], "left")
        .drop("_block")
    )


def with_cumulative_distance(legs: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """Kilometres driven before the segment starts; 0 on the first one."""
    out = along(
        legs,
        ["route_id"],
        "segment_position",
        running={"cumulative_distance_km": ("segment_distance_km", "before")},
        extent=extent,
    )
    return out.withColumn("cumulative_distance_km", F.round("cumulative_distance_km", 6))


def gold_legs(segments: DataFrame, stops: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Segments with both stop roles, load, distance, flags and running distance."""
    roles = with_stop_roles(segments, stops, packages)
    km = haversine_km(*[F.col(c) for c in ("from_lat", "from_lng", "to_lat", "to_lng")])
    legs = roles.withColumns(
        {
            "segment_distance_km": F.round(km, 6),
            "is_depot_segment": scalars.depot_flag(F.col("from_stop_type")),
            "same_zone": scalars.same_zone(F.col("from_zone_id"), F.col("to_zone_id")),
        }
    )
    return with_cumulative_distance(legs, extent=segments)


def gold_segments(
    segments: DataFrame,
    stops: DataFrame,
    packages: DataFrame,
    routes: DataFrame,
    weather: DataFrame,
    calendar: DataFrame,
) -> DataFrame:
    def wave(segments: DataFrame, stops: DataFrame, packages: DataFrame, routes: DataFrame) -> DataFrame:
        legs = gold_legs(segments, stops, packages)
        context = route_context(routes, packages, weather, calendar)
        return with_route_context(legs, context, extent=segments)

    joined = in_waves(wave, "route_id", segments, stops, packages, routes)
    position, total = F.col("segment_position"), F.col("route_total_stops")
    return scalars.conform(
        joined.withColumns(
            {
                "segment_ratio": scalars.segment_ratio(position, total),
                "has_rain": scalars.rain_flag(F.col("rain_sum_mm")),
                "travel_time_seconds": F.round("travel_time_seconds", 3),
            }
        ),
        schemas.GOLD_SEGMENTS,
    )
