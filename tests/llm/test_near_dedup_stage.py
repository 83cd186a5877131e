"""The pipeline's near_dedup links what operator 2 links."""

import random

import corpus_pipeline
from stopwise.llm import simhash


def bits(a, b):
    return bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1")


def test_stage_keeps_one_of_every_component(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    # one word less at an end moves few bits; repeats of a text keep shingles but not their shares
    texts += [t.rsplit(" ", 1)[0] for t in texts] + [t.split(" ", 1)[1] for t in texts] + [t + "  " for t in texts]
    texts += ["", None, "one two", "One  TWO", texts[0].upper()]
    rows = [*enumerate(texts, 10), (None, texts[1]), (12, "another text of row twelve"), (13, texts[0])]
    marks = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bits(marks[i], marks[j]) <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    heads = {doc for i, (doc, _) in enumerate(rows) if least.get(find(i)) == doc}
    want = [(d, t) for d, t in rows if d is None or d in heads]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(want) < len(rows) - 6


def test_sets_that_are_alike_but_fingerprints_that_are_not_stay(spark):
    """A text and the same text with a passage repeated have one set of shingles nearly, and far
    fingerprints: operator 2 does not link them."""
    rng = random.Random(9)
    for _ in range(200):
        words = [rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(60)]
        a, b = " ".join(words), " ".join(words[:30] * 5 + words)
        if bits(simhash.fingerprint(a.encode()), simhash.fingerprint(b.encode())) > 2:
            break
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, df, "").count() == 2
