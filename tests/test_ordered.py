"""Blocked windows, ranks and numbering against plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stopwise.operators.ordered import along, hash_numbered, numbered
from stopwise.operators.ranks import percentiles, ranked_values


@pytest.fixture(scope="module")
def walk(spark):
    rows = [("long", i, float(i % 7)) for i in range(95) if i not in (20, 21, 22, 23)]
    rows += [("short", i, 1.0) for i in range(3)] + [("one", 0, 5.0)]
    return spark.createDataFrame(rows, "route_id string, position int, km double")


def by_route(df):
    pdf = df.toPandas().sort_values(["route_id", "position"]).reset_index(drop=True)
    return pdf[sorted(pdf.columns)]


@pytest.mark.parametrize("block", [5, 10, 1000])
def test_blocks_equal_plain_window(walk, block):
    w = Window.partitionBy("route_id").orderBy("position")
    plain = walk.select(
        "*",
        F.lag("km").over(w).alias("prev"),
        F.coalesce(F.sum("km").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(
            "before"
        ),
        F.sum("km").over(w).alias("through"),
        F.row_number().over(w).alias("n"),
    )
    got = along(
        walk,
        ["route_id"],
        "position",
        previous={"prev": "km"},
        running={"before": ("km", "before"), "through": ("km", "through")},
        number="n",
        block_rows=block,
    )
    pd.testing.assert_frame_equal(by_route(got), by_route(plain), check_dtype=False)


def test_numbered_by_levels(spark):
    rows = [("a", d, p, s) for d in range(3) for p in range(2) for s in range(4)]
    df = spark.createDataFrame(rows, "k string, d int, p int, s int")
    got = numbered(df, ["k"], ["d", "p", "s"], "n").toPandas()
    want = got.sort_values(["d", "p", "s"]).reset_index(drop=True)
    assert list(want["n"]) == list(range(1, 25))


def test_hash_numbered_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("route_id"), (F.col("id") % 3).alias("g"))
    got = hash_numbered(df, F.col("route_id"), "n", first=[F.col("g")]).toPandas()
    assert sorted(got["n"]) == list(range(1, 5001))
    assert got.sort_values("n")["g"].is_monotonic_increasing


@pytest.mark.parametrize("hot", [False, True])
def test_percentiles_and_ranks(spark, hot):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(4000) < 0.4, 0.0, rng.normal(size=4000)) if hot else rng.normal(size=4000)
    pdf = pd.DataFrame({"g": np.where(np.arange(4000) % 3 == 0, "a", "b"), "v": v})
    df = spark.createDataFrame(pdf)
    probs = {"p05": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = percentiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(part["v"].quantile(p), abs=1e-12)
    ranks = ranked_values(df, "v").toPandas().set_index("v")["avg_rank"]
    pd.testing.assert_series_equal(
        pdf["v"].map(ranks), pdf["v"].rank(), check_names=False, check_dtype=False
    )


def test_percentiles_of_little(spark):
    assert percentiles(spark.createDataFrame([(4.0,)], "v double"), "v", {"m": 0.5}).first()[0] == 4.0
    empty = spark.createDataFrame([], "v double")
    assert percentiles(empty, "v", {"m": 0.5}).first()["m"] is None


def test_a_route_longer_than_a_block(spark):
    """Positions past 4,096 switch running sums and route attributes to the blocked form."""
    from stopwise.operators.gold import with_cumulative_distance, with_route_context

    legs = spark.range(1, 5001).select(
        F.lit("L").alias("route_id"),
        F.col("id").cast("int").alias("segment_position"),
        F.lit(0.5).alias("segment_distance_km"),
    )
    context = spark.createDataFrame([("L", "D"), ("other", "E")], "route_id string, station_code string")
    out = with_route_context(with_cumulative_distance(legs), context).toPandas()
    assert len(out) == 5000 and set(out["station_code"]) == {"D"}
    assert (out["cumulative_distance_km"] == (out["segment_position"] - 1) * 0.5).all()
