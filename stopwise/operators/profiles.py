"""Station history, and catalogues built from it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators.ranks import long_form, percentiles

PROBS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def top_zones(df: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent zones of each station. Zones are counted first and the rank filter
    keeps k rows per station and task before the shuffle."""
    counts = df.filter("to_zone_id IS NOT NULL").groupBy("station_code", "to_zone_id").agg(
        F.count("*").alias("n")
    )
    w = Window.partitionBy("station_code").orderBy(F.desc("n"), F.asc("to_zone_id"))
    return counts.withColumn("zone_rank", F.row_number().over(w)).filter(F.col("zone_rank") <= k)


def station_profile(train: DataFrame, zones: int = 50) -> DataFrame:
    """Per station: rows, five percentiles of each load column, and the most seen zones."""
    long = long_form(train, schemas.LOAD_COLUMNS, ["station_code"])
    cut = percentiles(long, "value", PROBS, ["station_code", "column"])
    vector = F.array(*PROBS)
    loads = cut.groupBy("station_code").agg(
        *[
            F.max(F.when(F.col("column") == c, vector)).alias(c)
            for c in schemas.LOAD_COLUMNS
        ]
    )
    # At most ``zones`` entries per station.
    best = top_zones(train, zones).groupBy("station_code").agg(
        F.sort_array(F.collect_list(F.struct("zone_rank", "to_zone_id"))).alias("z")
    )
    rows = train.groupBy("station_code").agg(F.count("*").alias("segments"))
    return (
        rows.join(loads, "station_code", "left")
        .join(best, "station_code", "left")
        .select(
            "station_code",
            "segments",
            *schemas.LOAD_COLUMNS,
            F.col("z.to_zone_id").alias("zones_seen"),
        )
    )


def station_catalogue(profile: DataFrame) -> DataFrame:
    return profile.select("station_code", "segments").orderBy(F.desc("segments"), "station_code")


def route_catalogue(gold: DataFrame, station: str | None = None, limit: int | None = None):
    """Routes of the bank, optionally of one station, in id order; a ``limit`` cuts the list."""
    rows = gold if station is None else gold.filter(F.col("station_code") == station)
    out = rows.groupBy("route_id").agg(
        F.max("station_code").alias("station_code"),
        F.max("segment_position").alias("segment_count"),
        F.max("departure_hour").alias("departure_hour"),
        F.max("weekday").alias("weekday"),
        F.max("route_date").alias("route_date"),
    )
    return out if limit is None else out.orderBy("route_id").limit(limit)
