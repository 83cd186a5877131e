"""Texts of short periods."""

import collections

import numpy as np
import pytest
from test_documents import plain_removal

from stopwise.llm import suffix_dedup


def periodic():
    rng = np.random.default_rng(6)
    noise = ["".join(rng.choice(list("abcdefgh"), 300)) for _ in range(4)]
    texts = ["a" * 5000, "-" * 200, "a" * 199 + "b", "=" * 201, "ab" * 900 + noise[0], noise[1] + "xyz" * 400 + noise[2]]
    texts += ["xyz" * 70, "y" + "zxy" * 80, noise[3] + "b" * 350 + noise[3], "0123456789" * 60 + "0123456789a" * 60, "q" * 400 + "r" * 400]
    word = "".join(rng.choice(list("abcdefgh"), 90))
    return [*texts, word * 12, word * 3, " " * 3000 + "\n" * 500, "a" * 260 + "-" * 230]


def test_periods_against_all_strings(spark):
    texts = periodic()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df).drop("kept").collect()
    want = plain_removal([t.encode() for t in texts], 200)
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *w) for i, w in enumerate(want))


@pytest.mark.parametrize("period", [1, 2, 7, 30])
def test_periods_write_little(period):
    rng = np.random.default_rng(period)
    raw = (rng.integers(97, 123, period, np.uint8).tobytes() * 60_000)[:60_000]
    ((buffer, text, *_),) = suffix_dedup.chunks([raw], 200)
    first, last, anchor, gram = suffix_dedup.runs(buffer, text, 200)
    kept, sure = suffix_dedup.without_periods(raw, text, first, last, anchor, gram, 200)
    assert kept.sum() <= 6 and len(sure) == 1
    assert int((last - first + 200)[kept].sum()) < 3000
    # every string is kept or sure
    covered = np.zeros(len(raw) - 199, bool)
    for a, b in [*zip(first[kept], last[kept]), *sure]:
        covered[a : b + 1] = True
    assert covered.all()
