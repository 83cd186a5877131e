"""Target statistics of the rows before a row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stopwise.operators import encode


def test_ordered_statistics_with_a_hot_category(spark):
    zones = ["hot"] * 3000 + [f"z{i % 40}" for i in range(2500)] + [None] * 500
    rows = [(f"R{i // 7}", i % 7, z, None if i % 97 == 0 else float(i * 37 % 101)) for i, z in enumerate(zones)]
    df = spark.createDataFrame(rows, "route_id string, segment_position int, zone string, travel_time_seconds double").repartition(7)
    key = F.concat_ws(":", "route_id", F.col("segment_position").cast("string"))
    got = encode.encode_ordered(df, "zone", "code", key)
    assert got.columns == [*df.columns, "code"]
    known = [r[3] for r in rows if r[3] is not None]
    prior, sums = sum(known) / len(known), {}
    want = {}
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest()):
        s, n = sums.get(r[2], (0.0, 0))
        want[r[:2]] = (s + 20 * prior) / (n + 20)
        if r[3] is not None:
            sums[r[2]] = (s + r[3], n + 1)
    found = {(r.route_id, r.segment_position): r.code for r in got.collect()}
    assert found.keys() == want.keys()
    assert [found[k] for k in want] == pytest.approx(list(want.values()))
