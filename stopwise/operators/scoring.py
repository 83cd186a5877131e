"""Applying fitted models to segments and routes."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.functions.scalars import clip_non_negative
from stopwise.operators.ordered import along

X, POP = "segment_distance_km", "is_depot_segment"


def score_lines(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``prediction`` from one line per population (two rows), floored at zero."""
    coef = lines.select(POP, F.col("slope").alias("_slope"), F.col("intercept").alias("_icpt"))
    raw = F.col("_slope") * F.col(X) + F.col("_icpt")
    scored = df.join(F.broadcast(coef), POP, "left")
    return scored.withColumn("prediction", clip_non_negative(raw)).drop("_slope", "_icpt")


def score_segments(df: DataFrame, models: dict[int, PipelineModel]) -> DataFrame:
    """Each row by the model of its population, floored at zero. Rows of an unknown population, or
    of one without a model, stay with a null prediction."""
    known = F.coalesce(F.col(POP).isin(*models), F.lit(False))
    out = df.filter(~known).withColumn("prediction", F.lit(None).cast("double"))
    for flag, model in models.items():
        part = model.transform(df.filter(F.col(POP) == flag)).select(
            *df.columns, clip_non_negative(F.col("prediction")).alias("prediction")
        )
        out = out.unionByName(part)
    return out


def with_arrival_seconds(scored: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """Driving seconds from departure to each stop."""
    return along(
        scored,
        ["route_id"],
        "segment_position",
        running={"arrival_seconds": ("prediction", "through")},
        extent=extent,
    )


def with_eta(
    scored: DataFrame, include_service: bool = True, extent: DataFrame | None = None
) -> DataFrame:
    """Arrival at each stop: departure, driving so far, and the service of earlier stops.

    Needs ``departure_timestamp_utc``.
    """
    timed = along(
        scored,
        ["route_id"],
        "segment_position",
        running={
            "arrival_seconds": ("prediction", "through"),
            "service_before_seconds": ("service_time_at_destination_seconds", "before"),
        },
        extent=extent,
    )
    seconds = F.col("arrival_seconds")
    if include_service:
        seconds = seconds + F.col("service_before_seconds")
    departed = F.unix_micros("departure_timestamp_utc")
    eta = F.timestamp_micros((departed + F.round(seconds * 1000) * 1000).cast("bigint"))
    return timed.withColumn("eta", eta)


def route_totals(df: DataFrame) -> DataFrame:
    """Predicted and real driving seconds per route."""
    return df.groupBy("route_id").agg(
        F.count("*").alias("segment_count"),
        F.sum("prediction").alias("predicted_seconds"),
        F.sum("travel_time_seconds").alias("real_seconds"),
    )


# The columns a route case shows; the target is kept apart.
CASE_COLUMNS = [
    "route_id",
    "segment_position",
    "from_stop_id",
    "to_stop_id",
    "from_lat",
    "from_lng",
    "to_lat",
    "to_lng",
    "segment_distance_km",
    "is_depot_segment",
    "same_zone",
    "to_zone_id",
    "cumulative_distance_km",
    "packages_at_destination",
    "service_time_at_destination_seconds",
    "volume_at_destination_cm3",
    "packages_with_window_at_destination",
    "departure_hour",
    "route_total_stops",
    "route_package_count",
    "weekday",
    "station_code",
]


def route_case(bank: DataFrame, route_id: str) -> tuple[DataFrame, DataFrame]:
    """Input columns of one route, and its hidden target, as two tables."""
    route = bank.filter(F.col("route_id") == route_id)
    shown = route.select(*CASE_COLUMNS, F.array().cast("array<string>").alias("estimated_fields"))
    return shown, route.select("route_id", "segment_position", "travel_time_seconds")
