"""Data-quality checks. Each table is scanned once per check set."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.correlation import correlations
from stopwise.operators.stops import station_centroids


def _nulls(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row."""
    a, b = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1))
    return a.join(F.broadcast(b), "_one").drop("_one")


def check_join_keys(routes: DataFrame, weather: DataFrame, calendar: DataFrame) -> DataFrame:
    w = weather.select(
        "station_code", F.col("weather_date").alias("route_date"), F.lit(1).alias("_w")
    )
    c = calendar.select(F.col("calendar_date").alias("route_date"), F.lit(1).alias("_c"))
    return (
        routes.select("station_code", "route_date")
        .join(w, ["station_code", "route_date"], "left")
        .join(c, "route_date", "left")
        .agg(
            _nulls("_w").alias("routes_without_weather_match"),
            _nulls("_c").alias("routes_without_calendar_match"),
        )
    )


def check_route_table(gold: DataFrame, tolerance_km: float = 0.001) -> DataFrame:
    split = (
        F.col("total_haversine_distance_km")
        - F.col("depot_to_first_stop_distance_km")
        - F.col("delivery_haversine_distance_km")
    )
    return gold.agg(
        _nulls("temperature_2m_mean_c").alias("routes_without_weather"),
        _nulls("weekday").alias("routes_without_calendar"),
        _nulls("package_count").alias("routes_without_packages"),
        _nulls("stop_rows").alias("routes_without_stops"),
        _nulls("total_haversine_distance_km").alias("routes_without_haversine_distance"),
        _nulls("depot_to_first_stop_distance_km").alias("routes_without_depot_distance"),
        _nulls("route_duration_seconds").alias("routes_without_duration"),
        F.count_if(F.col("other_scan_status_count") != 0).alias("routes_with_unknown_scan_status"),
        F.count_if(F.abs(split) > tolerance_km).alias("routes_with_inconsistent_distance_split"),
    )


def check_segment_table(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count("*").alias("segments"),
        F.count_distinct("route_id").alias("routes"),
        _nulls("travel_time_seconds").alias("segments_without_target"),
        _nulls("segment_distance_km").alias("segments_without_distance"),
        _nulls("station_code").alias("segments_without_station"),
        _nulls("temperature_2m_mean_c").alias("segments_without_weather"),
        F.count_if(F.col("is_depot_segment") == 1).alias("depot_segments"),
    )


# Layer checks that must be 0, and those that must be above 0.
MUST_BE_ZERO = {
    "silver": ["routes_without_weather_match", "routes_without_calendar_match"],
    "gold_routes": [
        "routes_without_weather",
        "routes_without_calendar",
        "routes_without_packages",
        "routes_without_stops",
    ],
    "gold_segments": ["segments_without_target", "segments_without_distance"],
}
MUST_BE_POSITIVE = {"gold_segments": ["segments"]}


def long_checks(layer: str, one_row: DataFrame) -> DataFrame:
    names = one_row.columns
    wide = one_row.select([F.col(c).cast("bigint").alias(c) for c in names])
    long = wide.unpivot([], names, "check", "value").withColumn("layer", F.lit(layer))
    zero, positive = MUST_BE_ZERO.get(layer, []), MUST_BE_POSITIVE.get(layer, [])
    ok = (
        F.when(F.col("check").isin(zero), F.col("value") == 0)
        .when(F.col("check").isin(positive), F.col("value") > 0)
        .otherwise(F.lit(True))
    )
    return long.select("layer", "check", "value", ok.alias("ok"))


def quality_gate(checks: dict[str, DataFrame]) -> DataFrame:
    """All checks of all layers, closed by one row that says whether every one held."""
    rows = None
    for layer, one_row in checks.items():
        part = long_checks(layer, one_row)
        rows = part if rows is None else rows.unionByName(part)
    verdict = rows.agg(
        F.lit("all").alias("layer"),
        F.lit("failed_checks").alias("check"),
        F.count_if(~F.col("ok")).alias("value"),
        F.bool_and("ok").alias("ok"),
    )
    return rows.unionByName(verdict)


def null_profile(df: DataFrame) -> DataFrame:
    cols = df.columns
    counts = df.agg(F.count("*").alias("_rows"), *[_nulls(c).alias(c) for c in cols])
    long = counts.unpivot(["_rows"], cols, "column", "nulls")
    return long.select(
        "column",
        "nulls",
        F.when(F.col("_rows") > 0, F.round(F.col("nulls") / F.col("_rows") * 100, 4)).alias(
            "percent"
        ),
    )


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, n), nulls included. Counted map-side before the one shuffle."""
    wide = df.select([F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "value").groupBy("column", "value").agg(
        F.count("*").alias("n")
    )


def constant_columns(df: DataFrame, near: float = 0.99) -> DataFrame:
    """Distinct values per column, null being one, and the share of the most frequent."""
    found = value_frequencies(df, df.columns).groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        F.round(F.max("n") / F.sum("n"), 6).alias("top_share"),
        (F.max("n") > near * F.sum("n")).alias("_near"),
    )
    constant = F.col("distinct_values") <= 1
    return found.select(
        "column",
        "distinct_values",
        "top_share",
        constant.cast("int").alias("is_constant"),
        (~constant & F.col("_near")).cast("int").alias("is_near_constant"),
    )


def cardinality(df: DataFrame, columns: list[str] | None = None, approximate: bool = False):
    """Distinct non-null values per column; ``approximate`` needs one pass and no shuffle of
    values."""
    columns = columns or df.columns
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], columns, "column", "distinct_values")
    seen = value_frequencies(df, columns)
    return seen.groupBy("column").agg(F.count("value").alias("distinct_values"))


def duplicate_counts(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each whole row and of each key."""

    def extra(columns: list[str], name: str) -> DataFrame:
        groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
        return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(name))

    return beside(extra(df.columns, "duplicate_rows"), extra(key, "duplicate_keys"))


def negative_and_zero_profile(df: DataFrame, columns: list[str], many: float = 0.05) -> DataFrame:
    stats = df.agg(
        F.count("*").alias("_rows"),
        *[F.struct(
            F.count_if(F.col(c) < 0).alias("negatives"), F.count_if(F.col(c) == 0).alias("zeros")
        ).alias(c) for c in columns],
    )
    long = stats.unpivot(["_rows"], columns, "column", "s")
    share = F.col("s.zeros") / F.col("_rows")
    return long.select(
        "column",
        "s.negatives",
        "s.zeros",
        F.round(share * 100, 4).alias("zero_percent"),
        (share > many).cast("int").alias("many_zeros"),
    )


def equivalent_columns(df: DataFrame, columns: list[str], threshold: float = 0.9999) -> DataFrame:
    return correlations(df, columns).filter(F.abs("r") > threshold)


def weather_coverage(routes: DataFrame, weather: DataFrame) -> DataFrame:
    """Stations of the routes with the number of weather days each has."""
    days = weather.groupBy("station_code").agg(F.count("*").alias("weather_days"))
    return (
        routes.select("station_code")
        .distinct()
        .join(days, "station_code", "left")
        .select(
            "station_code",
            F.coalesce("weather_days", F.lit(0)).alias("weather_days"),
            F.col("weather_days").isNotNull().cast("int").alias("covered"),
        )
    )


def source_manifest(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Per station: coordinates and routes with a station point, next to the totals."""
    totals = routes.agg(
        F.min("route_date").alias("date_min"),
        F.max("route_date").alias("date_max"),
        F.count("*").alias("route_count"),
        F.count_distinct("station_code").alias("station_count"),
    )
    per_station = station_centroids(stops, 6).withColumn("_one", F.lit(1))
    return per_station.join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct routes per table (null where a table has no route)."""
    rows = None
    for name, df in tables.items():
        routes = F.count_distinct("route_id") if "route_id" in df.columns else F.lit(None)
        one = df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            routes.cast("bigint").alias("routes"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def profile_scope(profile_input: DataFrame, test_routes: DataFrame) -> DataFrame:
    """Held-out routes inside the input of a station profile; anything but 0 is a leak."""
    shared = profile_input.select("route_id").distinct().intersect(test_routes.select("route_id"))
    return shared.agg(F.count("*").alias("leaked_routes"))
