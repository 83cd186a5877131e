"""Joins that are useful on their own. Small sides are left to Catalyst, which broadcasts a table
only when the size of its files (or, at run time, of its shuffle) is under the threshold. A side with a row
for each route or stop is none of these, see ``by_route``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PACKED = 32  # bytes that a row takes in memory for one in files, at most


def by_route(df: DataFrame) -> DataFrame:
    """A side of a join that has a row for each route or stop, marked as not to be broadcast unless it would be
    small in memory too. Written ids in order take about a byte a row, so by the size of its files a table of
    millions of routes looks small, and the driver would have to hold it."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.hint("merge") if size * PACKED > most else df


def with_weather(df: DataFrame, weather: DataFrame, columns: list[str]) -> DataFrame:
    w = weather.select(
        F.col("station_code").alias("_station"), F.col("weather_date").alias("_day"), *columns
    )
    match = (F.col("station_code") == F.col("_station")) & (F.col("route_date") == F.col("_day"))
    return df.join(w, match, "left").drop("_station", "_day")


def with_calendar(df: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    c = calendar.select(F.col("calendar_date").alias("_day"), *columns)
    return df.join(c, F.col("route_date") == F.col("_day"), "left").drop("_day")


def optional_join(
    df: DataFrame, other: DataFrame | None, on: list[str], columns: T.StructType
) -> DataFrame:
    """Left join, or typed nulls when the other table does not exist."""
    if other is None:
        return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in columns})
    return df.join(by_route(other.select(*on, *[f.name for f in columns])), on, "left")


def unmatched(left: DataFrame, right: DataFrame, condition: Column | list[str]) -> DataFrame:
    return left.join(right, condition, "left_anti")


def in_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    return df.join(by_route(routes.select("route_id")), "route_id", "left_semi")


def not_in_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    return df.join(by_route(routes.select("route_id")), "route_id", "left_anti")


def prediction_vs_actual(scored: DataFrame, holdout: DataFrame) -> DataFrame:
    """Predicted next to hidden real seconds, per segment."""
    return scored.select("route_id", "segment_position", "is_depot_segment", "prediction").join(
        by_route(holdout.select("route_id", "segment_position", "travel_time_seconds")),
        ["route_id", "segment_position"],
    )
