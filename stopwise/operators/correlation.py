"""Pairwise-complete Pearson correlation of many columns in one pass."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums needed for every pair of columns, over the rows where both are known.

    Hundreds of pairs are too many aggregate buffers for generated code, so each task reduces its
    Arrow batches to k x k matrix products and emits one row per pair; a small sum joins the tasks.
    Values are shifted by the column minimum, which keeps the sums stable and makes the variance
    of a constant column exactly zero.
    """
    wide = df.select([F.col(c).cast("double").alias(c) for c in columns])
    low = wide.agg(*[F.min(c) for c in columns]).first()
    shift = np.array([0.0 if v is None else float(v) for v in low])
    k = len(columns)
    iu, ju = np.triu_indices(k, 1)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            known = ~np.isnan(x)
            x = np.where(known, x - shift, 0.0)
            m = known.astype(float)
            sx = x.T @ m
            sxx = (x * x).T @ m
            total += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, x.T @ x])
        cells = {name: total[p][iu, ju] for p, name in enumerate(MOMENTS)}
        yield pd.DataFrame({"i": iu, "j": ju, **cells})

    parts = wide.mapInPandas(
        reduce, "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS)
    )
    return parts.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r) for every pair of ``columns``; r is null when a side does not vary."""
    m = pair_moments(df, columns)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    r = F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - sx * sy) / F.sqrt(vx) / F.sqrt(vy))
    names = F.array(*[F.lit(c) for c in columns])
    return m.select(
        F.get(names, F.col("i")).alias("a"),
        F.get(names, F.col("j")).alias("b"),
        n.cast("bigint").alias("n"),
        r.alias("r"),
    )


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson aggregate, null when a side does not vary. The built-in one divides by zero there
    in ANSI mode."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def top_correlations(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    found = correlations(df, columns).filter("r IS NOT NULL")
    return found.orderBy(F.abs("r").desc(), "a", "b").limit(k)


def correlated_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, r) of each column with one target."""
    found = correlations(df, [*columns, target]).filter(F.col("b") == target)
    return found.select(F.col("a").alias("column"), "r")


def vif(df: DataFrame, columns: list[str], threshold: float = 5.0) -> DataFrame:
    """Variance inflation of each column on its complete cases.

    Only the k x k correlation matrix reaches the driver; its inverse's diagonal is the answer.
    """
    complete = df.select([F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = correlations(complete, columns).collect()
    varying = [c for c in columns if any(p["r"] is not None and c in (p["a"], p["b"]) for p in pairs)]
    at = {c: i for i, c in enumerate(varying)}
    matrix = np.eye(len(varying))
    for p in pairs:
        if p["r"] is not None:
            matrix[at[p["a"]], at[p["b"]]] = matrix[at[p["b"]], at[p["a"]]] = p["r"]
    values = np.diag(np.linalg.pinv(matrix))
    rows = [(c, round(float(v), 4), int(v > threshold)) for c, v in zip(varying, values)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, above_threshold int")
