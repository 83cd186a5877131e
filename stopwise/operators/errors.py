"""Where a model errs. Input: one scored row per segment with ``prediction``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.functions import scalars
from stopwise.operators.metrics import metrics
from stopwise.operators.ranks import percentiles

Y = "travel_time_seconds"


def error_by(oof: DataFrame, dim: str) -> DataFrame:
    """Metrics of the delivery legs per value of a column."""
    return metrics(oof.filter("is_depot_segment = 0"), Y, "prediction", [dim])


def with_route_third(oof: DataFrame) -> DataFrame:
    third = scalars.route_third(F.col("segment_position"), F.col("route_total_stops"))
    return oof.withColumn("route_third", third)


def bias_by_duration_decile(oof: DataFrame, parts: int = 10) -> DataFrame:
    """Quantile-cut deciles of the real duration: right-closed bins, equal edges merged."""
    d = oof.filter("is_depot_segment = 0").withColumn("residual", F.col(Y) - F.col("prediction"))
    probs = {f"q{i:02d}": i / parts for i in range(parts + 1)}
    row = percentiles(d, Y, probs).first()
    # At most parts + 1 edges come back.
    edges = sorted({row[k] for k in probs}) if row is not None else []
    y = F.col(Y)
    bin_ = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        bin_ = F.when(y <= edges[i + 1], i).otherwise(bin_)
    return (
        d.groupBy(bin_.alias("decile"))
        .agg(
            (F.avg(y) / 60).alias("mean_duration_min"),
            (F.avg("residual") / 60).alias("bias_min"),
            (F.avg(F.abs("residual")) / 60).alias("mae_min"),
            F.count("*").alias("n"),
        )
        .filter("decile IS NOT NULL")
    )


def relative_bias(oof: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Signed bias as a percentage of the population's mean duration."""
    bias, mean = F.avg(F.col(Y) - F.col("prediction")), F.avg(Y)
    out = oof.groupBy("is_depot_segment").agg(
        (bias / 60).alias("bias_min"),
        (mean / 60).alias("mean_min"),
        F.when(mean > 0, bias / mean * 100).alias("relative_percent"),
    )
    return out.withColumn("systematic", (F.abs("relative_percent") > threshold).cast("int"))


def worst_predictions(oof: DataFrame, k: int = 15) -> DataFrame:
    """The k largest residuals: a top-k per task, then one merge."""
    residual = F.col(Y) - F.col("prediction")
    worst = oof.orderBy(F.abs(residual).desc(), "route_id", "segment_position").limit(k)
    return in_minutes(worst)


def in_minutes(oof: DataFrame) -> DataFrame:
    """Predictions as people read them."""
    residual = F.col(Y) - F.col("prediction")
    return oof.select(
        "route_id",
        "segment_position",
        "station_code",
        "is_depot_segment",
        F.round(F.col(Y) / 60, 2).alias("real_min"),
        F.round(F.col("prediction") / 60, 2).alias("predicted_min"),
        F.round(residual / 60, 2).alias("residual_min"),
        "segment_distance_km",
        "same_zone",
    )


def suspicious_speed(worst: DataFrame, below_kmh: float = 3.0, over_km: float = 0.1) -> DataFrame:
    speed = scalars.implied_speed_kmh(F.col("segment_distance_km"), F.col("real_min"))
    slow = worst.withColumn("speed_kmh", speed)
    return slow.filter((F.col("speed_kmh") < below_kmh) & (F.col("segment_distance_km") > over_km))
