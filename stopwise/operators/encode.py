"""Mean encoding of high-cardinality categories without leakage, and scaling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.workspace import staged

Y = "travel_time_seconds"


def encode_out_of_fold(
    df: DataFrame, column: str, out: str, fold: str = "fold", weight: float = 20.0
) -> DataFrame:
    """(sum + weight * prior) / (n + weight) over the rows of the other folds. A category those
    rows never had gets the prior, their overall mean. The rows are read once for the sums, which are
    written, and once for the codes."""
    cells = staged(df.groupBy(column, fold).agg(F.sum(Y).alias("_s"), F.count(Y).alias("_n")), "cells")
    whole = cells.groupBy(column).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    folds = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    total = folds.agg(F.sum("_fs").alias("_as"), F.sum("_fn").alias("_an"))
    priors = folds.withColumn("_one", F.lit(1)).join(
        F.broadcast(total.withColumn("_one", F.lit(1))), "_one"
    )
    rest = F.col("_an") - F.col("_fn")
    prior = F.when(rest > 0, (F.col("_as") - F.col("_fs")) / rest)
    # One row per fold.
    priors = F.broadcast(priors.select(fold, prior.alias("_prior")))
    value = (F.col("_ts") - F.col("_s") + weight * F.col("_prior")) / (
        F.col("_tn") - F.col("_n") + weight
    )
    codes = cells.join(whole, column).join(priors, fold).select(column, fold, value.alias(out))
    return df.join(codes, [column, fold], "left")


def encode_ordered(df: DataFrame, column: str, out: str, key: Column, weight: float = 20.0) -> DataFrame:
    """(sum + weight * prior) / (n + weight) over the rows of the same category that come before a row
    in the order of md5(key), so that no row's own target is in its code. The prior is the mean of
    all rows; null is a category. ``key`` tells rows of a category apart.

    The first digits of the digest cut every category into pieces, however many rows it has; each
    piece is one window, and a table with a row for each piece carries the sums from piece to piece.
    ``df`` is read three times, so pass a written table.
    """
    rows = df.withColumn("_h", F.md5(key)).withColumn("_piece", F.substring("_h", 1, 3))
    inside = Window.partitionBy(column, "_piece").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(column).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(column, "_piece").agg(F.sum(Y).alias("_s"), F.count(Y).alias("_n"))
    pieces = pieces.select(
        F.col(column).alias("_c"),
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_ps"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_pn"),
    )
    prior = df.agg(F.avg(Y)).scalar()
    rows = rows.withColumn("_is", F.coalesce(F.sum(Y).over(inside), F.lit(0.0)))
    rows = rows.withColumn("_in", F.count(Y).over(inside))
    joined = rows.join(pieces, rows[column].eqNullSafe(F.col("_c")) & (F.col("_piece") == F.col("_p")))
    value = (F.col("_is") + F.col("_ps") + weight * prior) / (F.col("_in") + F.col("_pn") + weight)
    return joined.select(*[rows[c] for c in df.columns], value.alias(out))


def category_means(train: DataFrame, column: str, out: str, weight: float = 20.0) -> DataFrame:
    """The same encoding from all training rows, for rows outside training. The null category
    holds the prior, for categories not seen."""
    sets = train.groupingSets([[F.col(column)], []], column)
    stats = sets.agg(
        F.grouping(column).alias("_all"), F.sum(Y).alias("_s"), F.count(Y).alias("_n")
    )
    stats = staged(stats, "category-sums")
    prior = stats.filter("_all = 1").select(
        (F.col("_s") / F.col("_n")).alias("_prior"), F.lit(1).alias("_one")
    )
    each = stats.withColumn("_one", F.lit(1)).join(F.broadcast(prior), "_one")
    smooth = (F.col("_s") + weight * F.col("_prior")) / (F.col("_n") + weight)
    return each.select(
        column, F.when(F.col("_all") == 1, F.col("_prior")).otherwise(smooth).alias(out)
    )


def encode_with(df: DataFrame, means: DataFrame, column: str, out: str) -> DataFrame:
    known = means.filter(F.col(column).isNotNull())
    prior = means.filter(F.col(column).isNull()).select(out).scalar()
    joined = df.join(known, column, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), prior))


def scale_features(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise with the mean and population spread of ``train``; a spread under 1e-6 is 1."""
    stats = train.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    joined = df.withColumn("_one", F.lit(1)).join(
        F.broadcast(stats.withColumn("_one", F.lit(1))), "_one"
    )

    def scaled(c: str):
        spread = F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
        return (F.col(c) - F.col(f"_m_{c}")) / spread

    return joined.withColumns({c: scaled(c) for c in columns}).select(*df.columns)
