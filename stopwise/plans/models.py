"""Tables of the modelling stage: splits, folds, coefficients, predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import baselines, boosted, features, planning, profiles, splits
from stopwise.operators.joins import by_route
from stopwise.operators.lines import line_coefficients
from stopwise.operators.stops import depot_coordinates

OOF_COLUMNS = [
    "route_id",
    "station_code",
    "segment_position",
    "route_total_stops",
    "departure_hour",
    "weekday",
    "same_zone",
    "segment_distance_km",
    "is_depot_segment",
    "travel_time_seconds",
]


def plan(lake, name: str) -> DataFrame:
    get = lake.get
    if name == "route_split":
        return splits.split_routes(get("gold_segments"))
    if name == "folds":
        return splits.group_folds(get("train"))
    if name == "model_rows":
        rows = features.leak_free_features(get("gold_segments"))
        return splits.with_split(rows, get("route_split"))
    if name == "train":
        return get("model_rows").filter("is_test = 0").drop("is_test")
    if name == "train_folds":
        return get("train").join(by_route(get("folds").select("route_id", "fold")), "route_id")
    if name in ("encoded_train", "encoded_test"):
        rows = get("model_rows")
        train = boosted.with_inner_fold(get("train"))
        sides = boosted.encoded(train, rows.filter("is_test = 1").drop("is_test"))
        return sides[name == "encoded_test"]
    if name == "oof":
        scored = baselines.baseline_predictions(get("train_folds"), "fold")
        return scored.select(*OOF_COLUMNS, "fold", F.col("B3").alias("prediction"))
    if name == "lines":
        return line_coefficients(get("train"), ["is_depot_segment"])
    if name == "holdout":
        return splits.with_split(get("gold_segments"), get("route_split")).filter("is_test = 1").drop("is_test")
    if name == "station_profile":
        return profiles.station_profile(get("train"))
    if name == "depots":
        train = get("route_split").filter("is_test = 0")
        return depot_coordinates(get("gold_segments"), train)
    if name == "planned_stops":
        return planned_stops(get("gold_segments"))
    if name == "planned_routes":
        return planning.complete_planned_routes(
            get("planned_stops"), get("station_profile"), get("depots"), seed=7
        )
    if name == "proposals":
        return planning.propose_stop_order(get("planned_routes"), get("lines"))
    raise KeyError(name)


def planned_stops(gold: DataFrame) -> DataFrame:
    """Delivery stops as a planner would hand them in: some zones and loads still unknown."""
    number = F.substring("to_stop_id", 2, 20).cast("bigint")
    some_load = number % 2 != 0
    known = {
        c: F.when(some_load, F.col(c).cast("double"))
        for c in schemas.LOAD_COLUMNS
        if c != "packages_at_destination"
    }
    return gold.select(
        "route_id",
        "station_code",
        F.col("segment_position").alias("position"),
        F.col("to_stop_id").alias("stop_id"),
        F.col("to_lat").alias("lat"),
        F.col("to_lng").alias("lng"),
        F.when(number % 3 != 0, F.col("to_zone_id")).alias("to_zone_id"),
        "packages_at_destination",
        *[v.alias(k) for k, v in known.items()],
        "departure_hour",
        "weekday",
    )
