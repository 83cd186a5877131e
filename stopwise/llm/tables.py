"""Reading the given tables, and running counts over tables too large for one window."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
PIECE_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Fewer rows per Arrow batch, so that a batch of very long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def digits_for(rows: int) -> int:
    """Hex digits of a md5 that split ``rows`` rows into pieces of about PIECE_ROWS."""
    return max(1, math.ceil(math.log(max(1, rows) / PIECE_ROWS, 16))) if rows > PIECE_ROWS else 1


def running_before(
    df: DataFrame, group: str, key: str, order: list[Column], weight: Column, digits: int, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the same ``group`` that come earlier in
    the order (key, *order). ``key`` is a hex digest; its first ``digits`` digits split every group
    into pieces with a window of their own, and a table with one row per piece carries the sums over.
    ``df`` is read twice and must be a written table."""
    df = df.withColumn("_piece", F.substring(key, 1, digits)).withColumn("_w", weight)
    totals = df.groupBy(group, "_piece").agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(group).alias("_g"),
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_offset"),
    )
    inside = (
        Window.partitionBy(group, "_piece")
        .orderBy(F.col(key), *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)).cast("long"))
    joined = df.join(totals, df[group].eqNullSafe(totals["_g"]) & (df["_piece"] == totals["_p"]))
    return joined.withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_piece", "_w", "_g", "_p", "_offset", "_inside"
    )
