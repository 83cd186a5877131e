"""Near copies against all pairs in plain Python."""

import itertools
import random

from stopwise.llm import near_copies

SCHEMA = "doc_id long, text string"


def edited():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    common = " ".join(rng.choice(words) for _ in range(30))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) for _ in range(30)]
    texts += [t + " " + common for t in texts[:10]]
    for t in texts[:12] + [texts[0]] * 25:
        for edits in (1, 2, 3, 5):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += ["", None, "one two", "One  TWO", texts[0].upper()]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    return [*rows, rows[3], (None, texts[1])]


def plain(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in m if d is not None), default=None) for g, m in groups.items()}
    return [(doc, least[find(i)]) for i, (doc, _) in enumerate(rows)]


def test_near_copies_are_those_of_all_pairs(spark):
    rows = edited()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = lambda r: (str(r[0]), str(r[1]))
    want = plain(rows)
    assert sorted(map(key, near_copies.near_copies(df).collect())) == sorted(map(key, want))
    assert near_copies.near_copies(df.where("false")).count() == 0
