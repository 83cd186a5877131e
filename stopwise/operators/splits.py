"""Route-wise splits and folds. A route is never on both sides."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.operators.joins import by_route
from stopwise.operators.ordered import hash_numbered


def route_list(df: DataFrame) -> DataFrame:
    return df.select("route_id").distinct()


def split_routes(df: DataFrame, fraction: float = 0.20, seed: int = 7) -> DataFrame:
    """Every route with ``is_test``: the first max(1, floor(fraction * routes)) in the order of
    ``md5(seed:route_id)``. The order is a property of the ids, so the split is the same on any
    cluster and in any row order."""
    routes = route_list(df)
    n_test = routes.agg(F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.count("*")))).scalar()
    key = F.concat_ws(":", F.lit(str(seed)), "route_id")
    ranked = hash_numbered(routes, key, "_k")
    return ranked.select("route_id", (F.col("_k") <= n_test).cast("int").alias("is_test"))


def with_split(df: DataFrame, split: DataFrame, seed: int = 7) -> DataFrame:
    """Rows of routes with ``is_test`` of a split by ``split_routes``. The split is a cut in the order of
    ``md5(seed:route_id)``, so the one digest at the cut says the side of every row and no row moves."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "route_id"))
    cut = split.where("is_test = 1").agg(F.max(digest)).first()[0]
    return df.where("route_id IS NOT NULL").withColumn("is_test", (digest <= F.lit(cut)).cast("int"))


def split_validation(train: DataFrame, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """A second split inside the training routes, independent of the first."""
    return split_routes(train, fraction, seed).withColumnRenamed("is_test", "is_validation")


def train_routes(routes: DataFrame, test: DataFrame) -> DataFrame:
    return route_list(routes).join(by_route(route_list(test)), "route_id", "left_anti")


def group_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Routes with their size and fold: dealt in snake order from the largest down, ties by md5."""
    sizes = df.groupBy("route_id").agg(F.count("*").alias("segments"))
    ranked = hash_numbered(sizes, F.col("route_id"), "_k", first=[-F.col("segments")])
    turn = (F.col("_k") - 1) % (2 * k)
    fold = F.when(turn < k, turn + 1).otherwise(2 * k - turn)
    return ranked.select("route_id", "segments", fold.cast("int").alias("fold"))


def fold_sizes(segments: DataFrame, folds: DataFrame) -> DataFrame:
    """Routes and segments on both sides of every fold."""
    per = folds.groupBy("fold").agg(
        F.count("*").alias("routes_test"), F.sum("segments").alias("segments_test")
    )
    total = per.agg(
        F.sum("routes_test").alias("_r"), F.sum("segments_test").alias("_s")
    ).withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        "fold",
        "routes_test",
        "segments_test",
        (F.col("_r") - F.col("routes_test")).alias("routes_train"),
        (F.col("_s") - F.col("segments_test")).alias("segments_train"),
    )


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    shared = route_list(train).intersect(route_list(test))
    return shared.agg(F.count("*").alias("shared_routes"))


def assert_disjoint_routes(train: DataFrame, test: DataFrame) -> None:
    shared = overlap(train, test).first()[0]
    if shared:
        raise AssertionError(f"{shared} routes are on both sides of the split")


def pick_route(bank: DataFrame, route_id: str | None = None, seed: int = 0) -> DataFrame:
    """One named route, or the first in a seeded hash order."""
    if route_id is not None:
        return bank.filter(F.col("route_id") == route_id)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "route_id"))
    first = route_list(bank).orderBy(order, "route_id").limit(1)
    return bank.join(F.broadcast(first), "route_id", "left_semi")


def deterministic_sample(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows in a seeded hash order of their key: a top-n, kept per task before it is merged."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    return df.orderBy(order, *key).limit(n)
