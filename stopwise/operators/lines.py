"""Straight lines of time on distance, by population."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators.correlation import pair_corr

X, Y, POP = "segment_distance_km", "travel_time_seconds", "is_depot_segment"


def line_coefficients(df: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares slope and intercept per group: closed form, one partial aggregation."""
    return df.groupBy(*by).agg(
        F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept")
    )


def distance_time_fit(df: DataFrame) -> DataFrame:
    """Fit, correlation, error and implied speed of all rows and of each population.

    The total row is null in the population column.
    """
    fit = df.rollup(POP).agg(
        F.regr_slope(Y, X).alias("slope"),
        F.regr_intercept(Y, X).alias("intercept"),
        pair_corr(F.col(Y), F.col(X)).alias("r"),
        F.regr_r2(Y, X).alias("r2"),
        F.when(F.sum(Y) > 0, F.sum(X) / F.sum(Y) * 3600).alias("implied_kmh"),
        F.count("*").alias("n"),
    )
    own = fit.filter(F.col(POP).isNotNull()).select(POP, "slope", "intercept")
    every = fit.filter(F.col(POP).isNull()).select(
        F.col("slope").alias("slope_all"), F.col("intercept").alias("intercept_all")
    )
    # Two populations and one total: three rows at most.
    lines = own.withColumn("_one", F.lit(1)).join(
        F.broadcast(every.withColumn("_one", F.lit(1))), "_one"
    )
    err = df.select(POP, X, Y).join(F.broadcast(lines.drop("_one")), POP)
    mae = err.rollup(POP).agg(
        F.avg(F.abs(F.col(Y) - F.col("slope") * F.col(X) - F.col("intercept"))).alias("_own"),
        F.avg(F.abs(F.col(Y) - F.col("slope_all") * F.col(X) - F.col("intercept_all"))).alias(
            "_all"
        ),
    )
    mae = mae.select(
        F.col(POP).alias("_pop"),
        (F.when(F.col(POP).isNull(), F.col("_all")).otherwise(F.col("_own")) / 60).alias("mae_min"),
    )
    return fit.join(F.broadcast(mae), F.col(POP).eqNullSafe(F.col("_pop"))).drop("_pop")


def distance_residual(df: DataFrame) -> DataFrame:
    """Delivery rows with what the distance line leaves unexplained."""
    d = df.filter(F.col(POP) == 0)
    line = line_coefficients(d, [POP])
    return (
        d.join(F.broadcast(line), POP)
        .withColumn("residual", F.col(Y) - F.col("slope") * F.col(X) - F.col("intercept"))
        .drop("slope", "intercept")
    )
