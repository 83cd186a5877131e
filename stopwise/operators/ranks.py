"""Exact ranks and percentiles without gathering a group in one task.

Rows are first reduced to value counts. A bounded sketch of the values gives cut points, so a
bucket holds about 1/PIECES of the rows; running counts are taken per bucket and shifted by the
bucket totals, a table of at most PIECES rows per group.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stopwise.workspace import staged

MAX_PIECES = 1024


def _pieces(df: DataFrame) -> int:
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_PIECES, width))


def with_bucket(df: DataFrame, value: str, out: str = "_bucket") -> DataFrame:
    """Order-preserving bucket of a value. The cut points are fixed numbers once read, so a task
    that is run again sees the same buckets."""
    pieces = _pieces(df)
    probs = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(value, probs, pieces * 20)).first()[0] or []
    edges = [float("-inf"), *sorted({float(v) for v in found}), float("inf")]
    if len(edges) == 2:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=edges, inputCol=value, outputCol=out).transform(df)


def ranked_values(
    df: DataFrame, value: str, by: list[str] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """One row per (by, carry, value): ``n`` its rows, ``ties`` the rows of the ``by`` group with
    that value, ``below`` the rows with a smaller one, ``avg_rank`` the mid-rank."""
    by, carry = by or [], carry or []
    rows = with_bucket(df.filter(F.col(value).isNotNull()), value)
    counts = rows.groupBy(*by, "_bucket", *carry, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by, "_bucket").agg(F.sum("n").alias("_b"))
    past = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_bucket", F.coalesce(F.sum("_b").over(past), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = inside.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = (
        counts.withColumn("_upto", F.sum("n").over(upto))
        .withColumn("ties", F.sum("n").over(same))
        .join(totals, [*by, "_bucket"])
    )
    below = F.col("_before") + F.col("_upto") - F.col("ties")
    return ranked.select(
        *by,
        *carry,
        value,
        "n",
        "ties",
        below.alias("below"),
        (below + (F.col("ties") + 1) / 2).alias("avg_rank"),
    )


def mid_ranks(
    counts: DataFrame, value: str, weights: list[str], by: list[str] | None = None
) -> DataFrame:
    """Adds ``<weight>_rank``, the mid-rank of the value among as many rows as the weight says, for each
    of ``weights``. ``counts`` has one row per (by, value) and is read several times, so pass a written
    table."""
    by = by or []
    rows = with_bucket(counts, value)
    past = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(w).alias(f"_b_{w}") for w in weights])

    def earlier(column: str, w: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(w), F.lit(0))

    totals = totals.select(*by, "_bucket", *[earlier(f"_b_{w}", past).alias(f"_before_{w}") for w in weights])
    ranked = rows.withColumns({f"_in_{w}": earlier(w, inside) for w in weights})
    ranked = ranked.join(totals, [*by, "_bucket"])
    rank = {w: F.col(f"_before_{w}") + F.col(f"_in_{w}") + (F.col(w) + 1) / 2 for w in weights}
    return ranked.select(*counts.columns, *[r.alias(f"{w}_rank") for w, r in rank.items()])


def percentiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles, one column per entry of ``probs``.

    Only the rows of buckets that hold a wanted rank are counted by value and sorted. These buckets
    are written first, so that their size decides whether the rows stay where they are.
    """
    by = by or []
    rows = with_bucket(df.filter(F.col(value).isNotNull()), value)
    totals = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_b"))
    group = Window.partitionBy(*by)
    past = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by,
        "_bucket",
        "_b",
        F.coalesce(F.sum("_b").over(past), F.lit(0)).alias("_before"),
        F.sum("_b").over(group).alias("_total"),
    )

    def at(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    ranks = [f(at(p)) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = None
    for r in ranks:
        inside = (r >= F.col("_before")) & (r < F.col("_before") + F.col("_b"))
        wanted = inside if wanted is None else wanted | inside
    hit = staged(totals.filter(wanted), "wanted-buckets")
    kept = rows.select(*by, "_bucket", value).join(hit, [*by, "_bucket"])
    counts = kept.groupBy(*by, "_bucket", "_before", "_total", value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by, "_bucket").orderBy(value)
    placed = (
        counts.withColumn("_hi", F.col("_before") + F.sum("_n").over(w))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    def pick(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col(value)))

    picked = placed.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[pick(F.floor(at(p))).alias(f"_f_{k}") for k, p in probs.items()],
        *[pick(F.ceil(at(p))).alias(f"_c_{k}") for k, p in probs.items()],
    )

    def between(k: str, p: float) -> Column:
        lo, hi = F.col(f"_f_{k}"), F.col(f"_c_{k}")
        return (lo + (hi - lo) * (at(p) - F.floor(at(p)))).alias(k)

    return picked.select(*by, *[between(k, p) for k, p in probs.items()])


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of (keep, column, value) for numeric columns."""
    keep = keep or []
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keep, columns, "column", "value")
