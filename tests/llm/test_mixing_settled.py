"""Small sources beside large blocks."""

import collections

import pytest

from stopwise.llm import mixing


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_small_source_beside_large_blocks(spark, block):
    rows = [(i, "w " * 10, "small", "x") for i in range(5)] + [(100 + i, "w " * 500, "big", "x") for i in range(60)]
    rows += [(200, "", "small", "x"), (201, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string")
    taken, goals = collections.Counter(), {}
    for r in mixing.mix(docs, block=block).collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        goals[r.source] = round(r.target)
    assert goals["small"] == 150
    assert dict(taken) == goals


def test_rows_of_the_mix(spark):
    rows = [(i, "w " * 10, "small", "x") for i in range(5)] + [(100 + i, "w " * 500, "big", "x") for i in range(60)]
    docs = spark.createDataFrame([*rows, (200, "", "small", "x")], "doc_id long, text string, source string, _id string")
    # five documents three times each, and the empty one once
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.source for r in mixed.collect())["small"] == 15 + 1
