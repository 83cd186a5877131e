"""Boosted trees (MLlib) for single, per-population and candidate models."""

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions.scalars import clip_non_negative
from stopwise.operators.encode import category_means, encode_out_of_fold, encode_with
from stopwise.operators.grown import grown
from stopwise.operators.joins import by_route
from stopwise.operators.lines import line_coefficients
from stopwise.operators.metrics import metric_columns, metrics_by_population
from stopwise.operators.scoring import score_lines, score_segments
from stopwise.workspace import staged

Y, POP = schemas.TARGET, "is_depot_segment"
FEATURES = {0: schemas.DELIVERY_NUMERIC, 1: schemas.DEPOT_NUMERIC}
STATION, ZONE = "station_mean", "zone_mean"


def encoded(train: DataFrame, test: DataFrame, fold: str = "inner_fold"):
    """Both sides with mean-encoded station and zone: out of fold for training rows, so no row
    sees its own target; from all training rows for the others."""
    a, b = train, test
    for column, out in (("station_code", STATION), ("to_zone_id", ZONE)):
        means = category_means(train, column, out)
        a = encode_out_of_fold(a, column, out, fold)
        b = encode_with(b, means, column, out)
    return a, b


def with_inner_fold(train: DataFrame, parts: int = 5) -> DataFrame:
    """Folds for the encoding, by a hash of the route."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("inner"), "route_id")), 1, 6), 16, 10)
    return train.withColumn("inner_fold", h.cast("int") % parts)


def unknown_features(train: DataFrame, features: list[str]) -> list[str]:
    """Features that some training row does not know. The flag of any other is the same in all rows,
    so that no tree can split on it."""
    value = {f: F.col(f).cast("double") for f in features}
    row = train.agg(*[F.max(v.isNull() | F.isnan(v)).alias(f) for f, v in value.items()]).first()
    return [f for f in features if row[f]]


GROWN_ROWS = 1 << 21  # from here on a level's pass takes longer than to start Python for it


def fitted(train: DataFrame, features: list[str], loss: str = "absolute", **params) -> PipelineModel:
    """The same trees either way: grown from histograms where there are many rows; by MLlib itself where they are
    few, which saves starting Python for every level, or where it is to stop early."""
    pipeline = regressor(features, loss, unknown=unknown_features(train, features), **params)
    *before, assemble, gbt = pipeline.getStages()
    beyond = gbt.isDefined(gbt.validationIndicatorCol) or not 0 < gbt.getMaxDepth() < 16 or gbt.getMaxBins() > 256
    if beyond or train.count() < GROWN_ROWS:
        return pipeline.fit(train)
    rows = train
    for stage in before:
        rows = stage.transform(rows)
    model = grown(gbt, rows, assemble.getInputCols())
    return PipelineModel([*before, assemble, model])


def regressor(
    features: list[str], loss: str = "absolute", trees: int = 20, depth: int = 5,
    step: float = 0.2, validation: str | None = None, unknown: list[str] | None = None,
) -> Pipeline:
    """``unknown`` names the features that get a flag for unknown values, by default all."""
    unknown = features if unknown is None else unknown
    gbt = GBTRegressor(
        featuresCol="features", labelCol=Y, predictionCol="prediction", lossType=loss,
        maxIter=trees, maxDepth=depth, stepSize=step, seed=42, maxMemoryInMB=512,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    assemble = VectorAssembler(
        inputCols=[*(f"_known_{f}" for f in features), *(f"_unknown_{f}" for f in unknown)],
        outputCol="features",
        handleInvalid="error",
    )
    return Pipeline(stages=[*known_or_flagged(features), assemble, gbt])


def known_or_flagged(features: list[str]) -> list[SQLTransformer]:
    """Every feature as a number that is never null, and a flag where it was: a tree can then tell
    an unknown value from a zero, and no row is left out of a fit or of its predictions."""
    unknown = "({0} IS NULL OR isnan({0}))"
    known = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0D ELSE {0} END AS `_known_{1}`"
    columns = []
    for f in features:
        value = f"CAST(`{f}` AS DOUBLE)"
        columns.append(known.format(value, f))
        columns.append(f"CAST({unknown.format(value)} AS INT) AS `_unknown_{f}`")
    return [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]


def boosted_single(train: DataFrame, loss: str, **params) -> PipelineModel:
    """One ensemble for both populations."""
    features = [*schemas.DELIVERY_NUMERIC, POP, STATION]
    return fitted(train, features, loss, **params)


def features_of(flag: int, zone: bool = True) -> list[str]:
    """Features of a specialist; the zone only means something on delivery legs."""
    return [*FEATURES[flag], STATION, *([ZONE] if zone and flag == 0 else [])]


def boosted_by_population(train: DataFrame, zone: bool = True, loss: str = "absolute", **params):
    """One specialist per population; the fits are independent and run side by side."""

    def fit(flag):
        return fitted(train.filter(F.col(POP) == flag), features_of(flag, zone), loss, **params)

    with ThreadPool(len(FEATURES)) as pool:
        return dict(zip(FEATURES, pool.map(fit, FEATURES)))


def fit_with_early_stopping(train: DataFrame, validation_routes: DataFrame, features, **params):
    """Tree count found on held-out training routes, then a refit on all of training with it.

    MLlib stops when the validation error no longer falls by its tolerance.
    """
    held = validation_routes.select("route_id", (F.col("is_validation") == 1).alias("_held"))
    marked = train.join(by_route(held), "route_id")
    probe = fitted(marked, features, validation="_held", **params)
    found = probe.stages[-1].getNumTrees
    refit = fitted(train, features, **{**params, "trees": found})
    return refit, found


def input_players(model: PipelineModel, features: list[str]) -> list[int]:
    """For every input of the ensemble the number of its feature, be it the value or the flag."""
    inputs = model.stages[-2].getInputCols()
    return [features.index(name.removeprefix("_known_").removeprefix("_unknown_")) for name in inputs]


def importance(model: PipelineModel, features: list[str], **labels) -> list[tuple]:
    """(labels, feature, share) rows; their number is the number of features. A feature's flag for
    unknown values counts as the feature."""
    values = [0.0] * len(features)
    for player, v in zip(input_players(model, features), model.stages[-1].featureImportances.toArray()):
        values[player] += v
    return [(*labels.values(), f, float(v)) for f, v in zip(features, values)]


def mean_importance(spark: SparkSession, rows: list[tuple], labels: list[str]) -> DataFrame:
    """Split gain averaged over folds, in percent."""
    schema = ", ".join([*(f"{name} string" for name in labels), "feature string", "gain double"])
    df = spark.createDataFrame(rows, schema)
    keys = [c for c in labels if c != "fold"]
    means = df.groupBy(*keys, "feature").agg(F.avg("gain").alias("gain"))
    totals = means.groupBy(*keys).agg(F.sum("gain").alias("_t"))
    return means.join(totals, keys).select(
        *keys,
        "feature",
        F.when(F.col("_t") > 0, F.round(F.col("gain") / F.col("_t") * 100, 2)).alias(
            "gain_percent"
        ),
    )


CANDIDATES = ["line", "boosted", "boosted_zone"]


def candidate_predictions(df: DataFrame, k: int, **params) -> tuple[DataFrame, list[tuple]]:
    """Held-out predictions of every specialist candidate in every fold, and feature importances.

    ``df`` has a ``fold`` column from 1 to ``k``. The encoded rows of a fold are written once and
    read by all its fits.
    """
    out, gains = None, []
    keep = ["route_id", "segment_position", POP, Y, "fold"]
    # with and without a zone the depot's specialist is the same
    fits = [(name, flag) for name in CANDIDATES[1:] for flag in FEATURES if name == "boosted" or flag == 0]
    for f in range(1, k + 1):
        train = with_inner_fold(df.filter(F.col("fold") != f))
        train, test = encoded(train, df.filter(F.col("fold") == f))
        train, test = staged(train, "fold-train"), staged(test, "fold-test")

        def fit(name, flag, train=train):
            features = features_of(flag, name.endswith("zone"))
            return features, fitted(train.filter(F.col(POP) == flag), features, "absolute", **params)

        # the fits of a fold are independent and run side by side
        with ThreadPool(len(fits)) as pool:
            models = pool.starmap(fit, fits)
        line = score_lines(test, line_coefficients(train, [POP]))
        parts = [line.select(*keep, F.lit("line").alias("candidate"), "prediction")]
        for (name, flag), (features, model) in zip(fits, models):
            scored = model.transform(test.filter(F.col(POP) == flag))
            parts.append(
                scored.select(
                    *keep,
                    F.lit(name).alias("candidate"),
                    clip_non_negative(F.col("prediction")).alias("prediction"),
                )
            )
            gains += importance(
                model, features, candidate=name, population=str(flag), fold=str(f)
            )
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out, gains


def candidate_grid(predictions: DataFrame) -> DataFrame:
    """Every pairing of a delivery and a depot candidate, per fold.

    Each candidate is first reduced to sums; the pairs are made of those few rows.
    """
    e = F.col(Y) - F.col("prediction")
    sums = predictions.groupBy("fold", POP, "candidate").agg(
        F.count("*").alias("n"),
        F.sum(F.abs(e)).alias("ae"),
        F.sum(e * e).alias("se"),
        F.sum(Y).alias("y"),
        F.sum(F.col(Y) * F.col(Y)).alias("yy"),
    )
    names = ["n", "ae", "se", "y", "yy"]

    def side(flag: int, label: str) -> DataFrame:
        return sums.filter(F.col(POP) == flag).select(
            "fold", F.col("candidate").alias(label), *[F.col(c).alias(f"{label}_{c}") for c in names]
        )

    pairs = side(0, "delivery").join(F.broadcast(side(1, "depot")), "fold")
    n, ae, se, y, yy = (F.col(f"delivery_{c}") + F.col(f"depot_{c}") for c in names)
    spread = yy - y * y / n
    return pairs.select(
        "fold",
        "delivery",
        "depot",
        n.alias("n"),
        (ae / n / 60).alias("mae_min"),
        (F.sqrt(se / n) / 60).alias("rmse_min"),
        F.when(spread > 0, 1 - se / spread).alias("r2"),
    )


def best_candidate(grid: DataFrame) -> DataFrame:
    means = grid.groupBy("delivery", "depot").agg(F.avg("mae_min").alias("mae_min"))
    return means.orderBy("mae_min", "delivery", "depot").limit(1)


def candidate_effects(predictions: DataFrame) -> DataFrame:
    """Mean MAE per population and candidate next to its predecessor's: line to trees is the
    algorithm's effect, trees to trees with zone the zone's. Percent is the gain over the line."""
    per_fold = predictions.groupBy("fold", POP, "candidate").agg(*metric_columns(Y, "prediction"))
    mean = per_fold.groupBy(POP, "candidate").agg(F.avg("mae_min").alias("mae_min"))
    before = F.create_map(
        F.lit("boosted"), F.lit("line"), F.lit("boosted_zone"), F.lit("boosted")
    )
    new = mean.withColumn("against", F.try_element_at(before, F.col("candidate")))
    old = mean.select(
        POP, F.col("candidate").alias("against"), F.col("mae_min").alias("old_mae_min")
    )
    line = mean.filter("candidate = 'line'").select(POP, F.col("mae_min").alias("_line"))
    return (
        new.filter("against IS NOT NULL")
        .join(old, [POP, "against"])
        .join(line, POP)
        .select(
            POP,
            "candidate",
            "against",
            "mae_min",
            (F.col("mae_min") - F.col("old_mae_min")).alias("effect_min"),
            F.when(F.col("_line") > 0, (1 - F.col("mae_min") / F.col("_line")) * 100).alias(
                "gain_over_line_percent"
            ),
        )
    )


def evaluate_once(models: dict[int, PipelineModel], test: DataFrame) -> DataFrame:
    """Metrics of the final models on the held-out routes, by population and in total."""
    return metrics_by_population(score_segments(test, models), Y, "prediction")
