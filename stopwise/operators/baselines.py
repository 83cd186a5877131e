"""Four closed-form baselines, and cross-validation of any of them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.scalars import clip_non_negative
from stopwise.operators.splits import assert_disjoint_routes

X, Y, POP = "segment_distance_km", "travel_time_seconds", "is_depot_segment"
BASELINES = ["B0", "B1", "B2", "B3"]


def _sums() -> list[Column]:
    x, y = F.col(X), F.col(Y)
    cells = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    return [F.sum(v).alias(k) for k, v in cells.items()]


def _line(prefix: str) -> tuple[Column, Column]:
    n, sx, sy, sxx, sxy = (F.col(f"{prefix}{k}") for k in ("n", "sx", "sy", "sxx", "sxy"))
    det = n * sxx - sx * sx
    slope = F.when(det > 0, (n * sxy - sx * sy) / det).otherwise(F.lit(0.0))
    return slope, F.when(n > 0, (sy - slope * sx) / n)


def baseline_coefficients(df: DataFrame, fold: str | None) -> DataFrame:
    """One row per (fold, population) with the parameters of all baselines, trained on the rows of
    every other fold (on all rows when ``fold`` is None).

    Sums are additive, so what a fold trains on is the total minus its own sums: one pass whatever
    the number of folds.
    """
    keep = [fold] if fold else []
    per = df.groupBy(*keep, POP).agg(*_sums())
    names = ["n", "sx", "sy", "sxx", "sxy"]

    def total(rows: DataFrame, by: list[str], prefix: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(prefix + c) for c in names])

    pops = total(per, [POP], "tp_")
    every = total(per, [], "ta_").withColumn("_one", F.lit(1))
    if fold:
        folds = total(per, [fold], "fa_").withColumn("_one", F.lit(1))
        grid = folds.join(F.broadcast(every), "_one").join(
            F.broadcast(pops.withColumn("_one", F.lit(1))), "_one"
        )
        mine = per.select(fold, POP, *[F.col(c).alias("fp_" + c) for c in names])
        grid = grid.join(F.broadcast(mine), [fold, POP], "left")
    else:
        grid = pops.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one")
        zero = {f"{p}_{c}": F.lit(0.0) for p in ("fa", "fp") for c in names}
        grid = grid.withColumns(zero)
    left = {
        f"{out}{c}": F.col(f"t{p}_{c}") - F.coalesce(F.col(f"f{p}_{c}"), F.lit(0.0))
        for out, p in (("a_", "a"), ("p_", "p"))
        for c in names
    }
    grid = grid.withColumns(left)
    (s2, i2), (s3, i3) = _line("a_"), _line("p_")
    return grid.select(
        *keep,
        POP,
        F.when(F.col("a_n") > 0, F.col("a_sy") / F.col("a_n")).alias("mean"),
        F.when(F.col("a_sx") > 0, F.col("a_sy") / F.col("a_sx")).otherwise(0.0).alias("rate"),
        s2.alias("slope_all"),
        i2.alias("intercept_all"),
        s3.alias("slope"),
        i3.alias("intercept"),
    )


def baseline_predictions(df: DataFrame, fold: str | None) -> DataFrame:
    """Rows with columns B0 (mean), B1 (distance at one speed), B2 (one line), B3 (one line per
    population), each from rows outside the row's own fold. Lines are floored at zero."""
    coef = baseline_coefficients(df, fold)
    x = F.col(X)
    # Populations x folds: a handful of rows.
    scored = df.join(F.broadcast(coef), [*([fold] if fold else []), POP])
    return scored.withColumns(
        {
            "B0": F.col("mean"),
            "B1": x * F.col("rate"),
            "B2": clip_non_negative(F.col("slope_all") * x + F.col("intercept_all")),
            "B3": clip_non_negative(F.col("slope") * x + F.col("intercept")),
        }
    ).drop("mean", "rate", "slope_all", "intercept_all", "slope", "intercept")


def long_predictions(scored: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, model, prediction), one row per baseline."""
    return scored.select(*keep, *BASELINES).unpivot(keep, BASELINES, "model", "prediction")


def cross_validate(
    df: DataFrame,
    models: dict[str, Callable[[DataFrame, DataFrame], DataFrame]],
    k: int,
    fold: str = "fold",
) -> DataFrame:
    """Predictions of arbitrary models. Each callable takes (train, test) and returns the test
    rows with a ``prediction``; the fold count, not the data, sets the number of plans."""
    out = None
    for f in range(1, k + 1):
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        assert_disjoint_routes(train, test)
        for name, fit_predict in models.items():
            part = fit_predict(train, test).select(
                "route_id", "segment_position", POP, Y, "prediction", fold,
                F.lit(name).alias("model"),
            )
            out = part if out is None else out.unionByName(part)
    return out


def combine_populations(depot: DataFrame, delivery: DataFrame) -> DataFrame:
    return depot.unionByName(delivery)
