"""Trees grown from histograms are MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.operators import boosted, grown
from stopwise.operators.explain import tree_nodes


@pytest.fixture(autouse=True)
def however_few(monkeypatch):
    monkeypatch.setattr(boosted, "GROWN_ROWS", 0)


def rows_of(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[rng.random(n) < 0.2, 1] = 0.0
    y = np.round(60 * np.abs(x[:, 0]) + 20 * (x[:, 1] > 0.3) + rng.random(n), 3)
    rows = [(float(a), None if a > 1 else float(b), int(c * 3), float(v)) for (a, b, c), v in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c int, travel_time_seconds double").repartition(3).cache()


@pytest.mark.parametrize("loss", ["absolute", "squared"])
@pytest.mark.parametrize("n", [1, 40, 3000])
def test_trees_are_those_of_mllib(spark, loss, n):
    df, features = rows_of(spark, n, n), ["a", "b", "c"]
    own = boosted.fitted(df, features, loss, trees=6)
    pipeline = boosted.regressor(features, loss, unknown=boosted.unknown_features(df, features), trees=6)
    mllib = pipeline.fit(df)
    a, b = (tree_nodes(m.stages[-1], spark) for m in (own, mllib))
    for mine, theirs in zip(a, b, strict=True):
        assert mine["weight"] == theirs["weight"]
        for key in ("left", "right", "feature", "rows"):
            assert (mine[key] == theirs[key]).all()
        for key in ("threshold", "value"):
            assert np.allclose(mine[key], theirs[key], rtol=1e-9)
    assert np.allclose(own.stages[-1].featureImportances.toArray(), mllib.stages[-1].featureImportances.toArray())
    scored = own.transform(df).select("a", F.col("prediction").alias("p")).join(mllib.transform(df).select("a", "prediction"), "a")
    assert scored.where("abs(p - prediction) > 1e-9").isEmpty()


def test_blocks_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(grown, "BLOCK", 64)
    df = rows_of(spark, 1000, 7)
    cuts = [np.array([0.0]), np.array([-1.0, 1.0])]
    found = grown.blocks(df.select("a", F.col("c"), "travel_time_seconds"), ["a", "c"], "travel_time_seconds", cuts, 2).collect()
    assert sum(len(y) for _, y, _ in found) == 1000 and sum((bins[0] == 0).sum() for bins, _, _ in found) == df.where("a <= 0").count()


def test_unknown_labels_are_refused(spark):
    df = rows_of(spark, 20, 3).withColumn("travel_time_seconds", F.when(F.col("c") != 0, F.col("travel_time_seconds")))
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        boosted.fitted(df, ["a"], trees=2)
