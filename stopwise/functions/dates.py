"""Calendar table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_calendar(days: DataFrame, holidays: DataFrame, day: str = "route_date") -> DataFrame:
    """Every day between the first and last ``day`` of ``days``, with holiday marks.

    ``weekday`` counts from Monday = 0.
    """
    span = days.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo IS NOT NULL")
    dense = span.select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("calendar_date")
    )
    marked = holidays.select(F.col("holiday_date").alias("calendar_date")).distinct()
    # One row per day of a date range on both sides, so the broadcast side is bounded by the
    # length of the calendar whatever the size of the route table.
    joined = dense.join(
        F.broadcast(marked.withColumn("is_us_public_holiday", F.lit(1))), "calendar_date", "left"
    )
    d = F.col("calendar_date")
    return joined.select(
        d,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.weekday(d).alias("weekday"),
        F.date_format(d, "EEEE").alias("weekday_name"),
        F.when(F.weekday(d) >= 5, 1).otherwise(0).alias("is_weekend"),
        F.coalesce("is_us_public_holiday", F.lit(0)).alias("is_us_public_holiday"),
    )
