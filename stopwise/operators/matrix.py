"""Walked pairs against the travel-time matrix."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators.joins import by_route
from stopwise.operators.stops import consecutive_pairs


def walked_seconds(pairs: DataFrame, matrix_rows: DataFrame) -> DataFrame:
    """Seconds of each walked pair, null where the matrix lacks it. Each origin's map meets at most
    the pair that leaves it, so the all-pairs cells are never exploded."""
    rows = matrix_rows.select("route_id", "from_stop_id", "seconds_to")
    return pairs.join(by_route(rows), ["route_id", "from_stop_id"], "left").select(
        "route_id",
        "segment_position",
        "from_stop_id",
        "to_stop_id",
        F.try_element_at("seconds_to", F.col("to_stop_id")).alias("travel_time_seconds"),
    )


def travel_segments(sequences: DataFrame, matrix_rows: DataFrame) -> DataFrame:
    return walked_seconds(consecutive_pairs(sequences), matrix_rows).filter(
        "travel_time_seconds IS NOT NULL"
    )


def matrix_coverage(sequences: DataFrame, matrix_rows: DataFrame) -> DataFrame:
    """One row: routes in the matrix, those without a sequence, expected and missing pairs."""
    seen = matrix_rows.select("route_id").distinct()
    ordered = sequences.select("route_id").distinct()
    seconds = walked_seconds(
        consecutive_pairs(sequences).join(by_route(seen), "route_id", "left_semi"), matrix_rows
    )
    pairs = seconds.agg(
        F.count("*").alias("expected_segments"),
        F.count_if(F.col("travel_time_seconds").isNull()).alias("missing_segments"),
        F.count("travel_time_seconds").alias("travel_time_segments"),
    )
    known = ordered.withColumn("_known", F.lit(1))
    routes = seen.join(by_route(known), "route_id", "left").agg(
        F.count("*").alias("travel_time_routes"),
        F.count_if(F.col("_known").isNull()).alias("routes_without_sequence"),
    )
    # Two one-row results side by side.
    one = F.lit(1).alias("_one")
    return routes.select("*", one).join(pairs.select("*", one), "_one").drop("_one")
