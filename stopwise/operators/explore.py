"""Descriptive statistics of the segment and route tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions import scalars
from stopwise.operators.correlation import pair_corr
from stopwise.operators.quality import beside, value_frequencies
from stopwise.operators.ranks import long_form, percentiles

TARGET = "travel_time_seconds"
DISTANCE = "segment_distance_km"


def overview(segments: DataFrame, routes: DataFrame) -> DataFrame:
    s = segments.agg(
        F.count("*").alias("segments"),
        F.lit(len(segments.columns)).alias("segment_columns"),
        F.min("route_date").alias("first_day"),
        F.max("route_date").alias("last_day"),
        F.count_distinct("station_code").alias("stations"),
    )
    r = routes.agg(
        F.count_distinct("route_id").alias("routes"),
        F.lit(len(routes.columns)).alias("route_columns"),
    )
    return beside(s, r)


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness; Spark's own is the population one."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c).cast("double")
    scale = (n - 1) / ((n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(c) + 6))


def target_summary(df: DataFrame, by: str = "is_depot_segment", value: str = TARGET) -> DataFrame:
    """Location, spread and shape of the target in minutes, per group."""
    minutes = df.select(by, (F.col(value) / 60).alias("m"))
    shape = minutes.groupBy(by).agg(
        F.count("m").alias("n"),
        F.round(F.avg("m"), 3).alias("mean_min"),
        F.round(F.stddev_samp("m"), 3).alias("sd_min"),
        F.round(F.max("m"), 2).alias("max_min"),
        F.round(sample_skewness("m"), 3).alias("skewness"),
        F.round(sample_kurtosis("m"), 3).alias("kurtosis"),
    )
    wanted = {"median_min": 0.5, "p05_min": 0.05, "p95_min": 0.95, "p99_min": 0.99}
    cut = percentiles(minutes, "m", wanted, [by])
    return shape.join(cut.withColumns({c: F.round(c, 3) for c in wanted}), by)


def population_ratio(df: DataFrame, value: str = TARGET) -> DataFrame:
    def mean(flag: int) -> Column:
        return F.avg(F.when(F.col("is_depot_segment") == flag, F.col(value)))

    return df.agg(F.round(mean(1) / mean(0), 3).alias("times_longer"))


def normality(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Jarque-Bera on all rows, raw and on log(1 + x); its p-value is exp(-JB / 2)."""
    long = df.select(F.col(value).alias("raw"), F.log1p(value).alias("log1p")).unpivot(
        [], ["raw", "log1p"], "scale", "x"
    )
    s, k = F.col("skewness"), F.col("excess_kurtosis")
    jb = F.col("n") / 6 * (s * s + k * k / 4)
    return (
        long.groupBy("scale")
        .agg(
            F.count("x").alias("n"),
            F.skewness("x").alias("skewness"),
            F.kurtosis("x").alias("excess_kurtosis"),
        )
        .withColumn("jarque_bera", jb)
        .withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))
    )


def describe_numeric(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    long = long_form(df, columns)
    shape = long.groupBy("column").agg(
        F.round(F.avg("value"), digits).alias("mean"),
        F.round(F.stddev_samp("value"), digits).alias("sd"),
        F.round(F.min("value"), digits).alias("min"),
        F.round(F.max("value"), digits).alias("max"),
        F.round(sample_skewness("value"), digits).alias("skewness"),
    )
    median = percentiles(long, "value", {"median": 0.5}, ["column"])
    out = shape.join(F.broadcast(median), "column", "left")
    skew = F.when(~F.isnan("skewness"), F.col("skewness"))
    return out.select(
        "column", "mean", "sd", "min", F.round("median", digits).alias("median"), "max",
        skew.alias("skewness"),
        F.coalesce((F.abs(skew) > 2).cast("int"), F.lit(0)).alias("strongly_skewed"),
    )


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cardinality, most frequent value, share of the three most frequent, values seen once.

    Shares are of all rows. The rank filter lets Spark keep three rows per column and task before
    the shuffle.
    """
    seen = value_frequencies(df, columns)
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = (
        seen.filter("value IS NOT NULL")
        .withColumn("_rank", F.row_number().over(w))
        .filter("_rank <= 3")
        .groupBy("column")
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col("value"))).alias("top_value"),
            F.max("n").alias("top_rows"),
            F.sum("n").alias("_top3"),
        )
    )
    facts = seen.groupBy("column").agg(
        F.count("value").alias("distinct_values"),
        F.count_if(F.col("value").isNotNull() & (F.col("n") == 1)).alias("seen_once"),
        F.sum("n").alias("_rows"),
    )
    return facts.join(top, "column").select(
        "column",
        "distinct_values",
        "top_value",
        "top_rows",
        F.round(F.col("_top3") / F.col("_rows") * 100, 2).alias("top3_percent"),
        "seen_once",
    )


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    long = long_form(df, columns).filter("value IS NOT NULL")
    q = percentiles(long, "value", {"q1": 0.25, "q3": 0.75}, ["column"])
    limits = q.select(
        "column",
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
    )
    # One row per analysed column.
    return (
        long.join(F.broadcast(limits), "column")
        .groupBy("column")
        .agg(
            F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias(
                "outliers"
            ),
            F.count("*").alias("_n"),
            F.round(F.max("high"), 3).alias("upper_limit"),
            F.round(F.max("value"), 3).alias("maximum"),
        )
        .withColumn("percent", F.round(F.col("outliers") / F.col("_n") * 100, 2))
        .drop("_n")
    )


def zero_second_segments(df: DataFrame) -> DataFrame:
    """Delivery legs of zero seconds; they are real and stay in the data."""
    zero = F.count_if(F.col(TARGET) == 0)
    return df.filter("is_depot_segment = 0").agg(
        zero.alias("zero_segments"), F.round(zero / F.count("*") * 100, 3).alias("percent")
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; bin 0 and bin ``bins + 1`` hold what lies outside."""
    b = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    width = (high - low) / bins
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(b.alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.round(F.lit(low) + (F.col("bin") - 1) * F.lit(width), 6))
    )


def same_zone_effect(df: DataFrame) -> DataFrame:
    known = df.filter("is_depot_segment = 0 AND same_zone IS NOT NULL")
    rows = known.groupBy("same_zone").agg(
        F.count("*").alias("n"),
        F.round(F.avg(TARGET) / 60, 3).alias("minutes"),
        F.round(F.avg(DISTANCE), 3).alias("km"),
    )
    total = known.agg(F.round(F.avg("same_zone") * 100, 2).alias("same_zone_percent"))
    return rows.withColumn("_one", F.lit(1)).join(
        F.broadcast(total.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


def means_by(df: DataFrame) -> DataFrame:
    """Mean delivery minutes by city, departure hour, weekday and date, in one scan."""
    d = df.filter("is_depot_segment = 0").select(
        scalars.city_code(F.col("station_code")).alias("city"),
        F.col("departure_hour").cast("string").alias("departure_hour"),
        F.col("weekday").cast("string").alias("weekday"),
        F.col("route_date").cast("string").alias("route_date"),
        TARGET,
    )
    dims = ["city", "departure_hour", "weekday", "route_date"]
    sets = [[F.col(c)] for c in dims]
    grouped = d.groupingSets(sets, *dims).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in dims],
        F.count("*").alias("n"),
        F.round(F.avg(TARGET) / 60, 3).alias("minutes"),
    )
    which, value = F.lit(None), F.lit(None)
    for c in dims:
        which = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(which)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), "n", "minutes")


def simpson_check(
    df: DataFrame, x: str = "has_rain", y: str = TARGET, group: str = "station_code",
    min_rows: int = 1,
) -> DataFrame:
    """Correlation over all rows next to the mean of the correlations inside each group that is
    large enough and in which ``x`` varies."""
    xd = F.col(x).cast("double")
    d = df.filter("is_depot_segment = 0").select(group, xd.alias("x"), F.col(y).alias("y"))
    inside = (
        d.groupBy(group)
        .agg(
            pair_corr(F.col("x"), F.col("y")).alias("r"),
            F.count("*").alias("n"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
        )
        .filter((F.col("n") >= min_rows) & (F.col("lo") < F.col("hi")))
        .agg(F.avg("r").alias("mean_within"), F.count("*").alias("groups"))
    )
    return beside(d.agg(pair_corr(F.col("x"), F.col("y")).alias("overall")), inside)


def rain_effect(df: DataFrame) -> DataFrame:
    """Delivery minutes with and without rain, and the rainy share, over all and per city."""
    d = df.filter("is_depot_segment = 0").withColumn(
        "city", scalars.city_code(F.col("station_code"))
    )
    wet = F.col("has_rain") == 1
    return d.rollup("city").agg(
        F.round(F.avg(F.when(wet, F.col(TARGET))) / 60, 3).alias("minutes_with_rain"),
        F.round(F.avg(F.when(~wet, F.col(TARGET))) / 60, 3).alias("minutes_without_rain"),
        F.round(F.avg("has_rain") * 100, 3).alias("rainy_percent"),
    ).withColumn("city", F.coalesce("city", F.lit("all")))


def route_time_split(routes: DataFrame) -> DataFrame:
    drive, serve = F.sum("total_travel_time_seconds"), F.sum("total_planned_service_time_seconds")
    return routes.agg(
        F.round(F.avg("route_duration_hours"), 2).alias("mean_hours"),
        F.round(F.min("route_duration_hours"), 2).alias("min_hours"),
        F.round(F.max("route_duration_hours"), 2).alias("max_hours"),
        F.round(drive / (drive + serve) * 100, 1).alias("driving_percent"),
        F.round(serve / (drive + serve) * 100, 1).alias("service_percent"),
    )


COMPOSITION = [
    "total_stops",
    "package_count",
    "unique_zones",
    "total_package_volume_cm3",
    "packages_per_dropoff_stop",
    "route_duration_hours",
]


def route_composition(routes: DataFrame) -> DataFrame:
    return describe_numeric(routes, COMPOSITION, 2).drop("skewness", "strongly_skewed")


def route_score_profile(routes: DataFrame) -> DataFrame:
    """Classes with their counts and mean hours; the smallest class's share on every row."""
    classes = routes.filter("route_score IS NOT NULL").groupBy("route_score").agg(
        F.count("*").alias("n"), F.round(F.avg("route_duration_hours"), 2).alias("mean_hours")
    )
    share = classes.agg(F.round(F.min("n") / F.sum("n") * 100, 2).alias("minority_percent"))
    return classes.withColumn("_one", F.lit(1)).join(
        F.broadcast(share.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")
