"""Per-route sequences for models that read a route in order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators.ordered import block_of, dealt, fits_one_block


def route_sequences(df: DataFrame, features: list[str], rows: int = 4096) -> DataFrame:
    """Feature vectors, target minutes and populations of a route in walked order.

    A row holds at most ``rows`` positions; a longer route goes on in the next ``chunk``. If
    none does, rows move once, by route, also for ``whole_routes``.
    """
    if fits_one_block(df, "segment_position", rows):
        own = ["route_id", "station_code", "segment_position", "travel_time_seconds", "is_depot_segment"]
        df = dealt(df.select(*dict.fromkeys([*own, *features])), "route_id", (df,))
    vector = F.array(*[F.col(c).cast("double") for c in features])
    item = F.struct(
        F.col("segment_position").alias("position"),
        vector.alias("x"),
        (F.col("travel_time_seconds") / 60).alias("y"),
        F.col("is_depot_segment").alias("population"),
    )
    packed = df.groupBy(
        "route_id", "station_code", block_of(F.col("segment_position"), rows).alias("chunk")
    ).agg(F.sort_array(F.collect_list(item)).alias("s"))
    return packed.select(
        "route_id",
        "station_code",
        "chunk",
        F.size("s").alias("length"),
        F.col("s.x").alias("x"),
        F.col("s.y").alias("y"),
        F.col("s.population").alias("population"),
    )


def whole_routes(chunks: DataFrame) -> DataFrame:
    """One row per route, its chunks put together in their order."""
    lists = ["x", "y", "population"]
    packed = chunks.groupBy("route_id", "station_code").agg(
        F.sum("length").cast("int").alias("length"),
        F.sort_array(F.collect_list(F.struct("chunk", *lists))).alias("c"),
    )
    return packed.select(
        "route_id", "station_code", "length", *[F.flatten(F.col(f"c.{n}")).alias(n) for n in lists]
    )
