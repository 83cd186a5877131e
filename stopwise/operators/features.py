"""What a model may see."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions.scalars import impute_features
from stopwise.operators.ordered import along

# Contain the target or are only known once the route is over.
BANNED = {"speed_kmh", "implied_speed_kmh", *schemas.ROUTE_OUTCOME_COLUMNS}


def population(df: DataFrame, depot: bool) -> DataFrame:
    return df.filter(F.col("is_depot_segment") == int(depot))


def assert_leak_free(columns: list[str]) -> None:
    leaks = sorted(BANNED.intersection(columns))
    if leaks:
        raise ValueError(f"columns known only after the route: {leaks}")


def leak_free_features(gold: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Model columns with defaults filled in. Asking for an outcome column raises."""
    wanted = [*schemas.MODEL_COLUMNS, *(extra or [])]
    assert_leak_free(wanted)
    return impute_features(gold.select(*dict.fromkeys(wanted)))


def route_order(df: DataFrame) -> DataFrame:
    return df.orderBy("route_id", "segment_position")


def same_zone_as_previous(stops: DataFrame, order: str, zone: str = "zone_id") -> DataFrame:
    """1 when the stop lies in the zone of the stop before it; unknown zones never match."""
    seen = along(stops, ["route_id"], order, previous={"_zone": zone})
    match = F.coalesce(F.col(zone) == F.col("_zone"), F.lit(False))
    return seen.withColumn("same_zone_as_previous", match.cast("int")).drop("_zone")
