"""The language model against plain Python."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import language_model as lm

SCHEMA = "doc_id long, text string, n_tokens string, row int"


def words(text):
    return (text or "").encode().lower().split() + [None]


def plain(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        out.append((i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, base))
    return out


def scores(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return [tuple(r) for r in lm.language_scores(df, digest % 5 == 1, F.floor(digest / 5), **how).collect()]


def key(r):
    return tuple(str(x) for x in r[:5])


def two_tongues(n=300):
    """Texts of two languages: words of one are hardly ever beside words of the other."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        own = "abcdefghij" if i % 2 else "klmnopqrst"
        rows.append((i, " ".join(own[int(rng.random() ** 2 * 10)] * rng.randint(1, 3) for _ in range(rng.randint(1, 60))), "x", 1))
    return rows


@pytest.mark.parametrize("dictionary", [1, 12, lm.WORDS])
def test_counts_and_base(spark, dictionary):
    rows = two_tongues()
    rows += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, " \t\x0b ", "x", 1), (None, "AAA aaa Äa\u00a0x", "x", 1)]
    rows += [(1003, "z" * 90 + " " + "z" * 89 + "y " + "Z" * 90, "x", 1), (1004, "new words only", "x", 1), rows[0], rows[0]]
    got, want = scores(spark, rows, words=dictionary), plain(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9)
        assert g[6] < 0


def test_better_than_base_on_texts_held_out(spark):
    out = [g for g in scores(spark, two_tongues()) if g[1]]
    assert len(out) > 30
    per_token = [sum(g[k] for g in out) / sum(g[2] for g in out) for k in (5, 6)]
    assert per_token[1] > per_token[0] + 0.1


def test_dictionary_does_not_change_scores(spark):
    rng = random.Random(7)
    bag = [f"w{i:x}" for i in range(6000) for _ in range(max(1, 15000 // (i + 1)))]
    rng.shuffle(bag)
    rows = [(i, " ".join(bag[k : k + 500]), "x", 1) for i, k in enumerate(range(0, len(bag), 500))]
    rows.append((9999, "never seen w0 before w1", "x", 1))
    one, two = (sorted(scores(spark, rows, words=n, rounds=2), key=key) for n in (5000, 1 << 18))
    assert one != two  # added up in another order
    for a, b in zip(one, two):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_empty(spark):
    assert scores(spark, []) == []
    ((*row, base, score),) = scores(spark, [(1, "a", "x", 1)]) if zlib.crc32(b"1") % 5 == 1 else scores(spark, [(5, "a", "x", 1)])
    assert row[2] == 2 and base <= 0 and score <= 1e-6


class Counts:
    """A vocabulary without Spark."""

    def __init__(self, counts):
        rows = sorted(counts.items(), key=lambda r: (r[0] != lm.END, -r[1], r[0]))
        self.blob = b"\n".join(k for k, _ in rows)
        self.counts = np.array([c for _, c in rows])
        self.n, self.v = int(self.counts.sum()), len(rows)
        self.mass = np.zeros(lm.ENDINGS)
        for k, c in rows[lm.TOP :]:
            self.mass[lm.ending(k)] += c + 0.5

    whole = lm.Vocabulary.whole


def small_model():
    rng = np.random.default_rng(1)
    vocabulary = Counts({lm.END: 40, **{f"w{i}".encode(): 1 + 4000 // (i + 1) for i in range(3300)}})
    ids = [rng.integers(0, 100, 60), np.append(rng.integers(0, lm.TOP, 30), lm.TOP + rng.integers(0, lm.ENDINGS, 9)), [0]]
    text = lm.Text([np.array(i, "<u2").tobytes() for i in ids])
    company = np.zeros((lm.START, lm.COMPANY))
    lm.company(text, company)
    model = lm.Model(vocabulary, company)
    model.weights = (rng.standard_normal(model.weights.shape) * 0.3).astype(np.float32)
    return vocabulary, model, text


def test_probabilities_add_up_to_one():
    vocabulary, model, text = small_model()
    seen = vocabulary.blob.split(b"\n")
    before = [5, 700, lm.TOP + 3]
    total = 0.0
    groups = collections.defaultdict(float)  # of words without a place: their part of their class
    for k, w in enumerate(seen):
        if k >= lm.TOP:
            groups[lm.TOP + lm.ending(w)] += (vocabulary.counts[k] + 0.5) / vocabulary.whole
    mass = collections.defaultdict(float)
    for g, m in groups.items():
        mass[model.class_of[g]] += m
    for i in [*range(lm.TOP), *groups]:
        whole = lm.Text([np.array([*before, i], "<u2").tobytes()])
        (part,) = model.softmaxes(whole)
        p = math.exp(part[3][-1])
        total += p if i < lm.TOP else p * groups[i] / mass[model.class_of[i]]
    total += math.exp(math.log(model.unknown) - part[2][-1])
    assert total == pytest.approx(1.0, abs=1e-4)


def test_gradient_by_differences():
    _, model, text = small_model()
    total = np.zeros_like(model.weights, np.float64)
    model.gradient(text, total)
    counts = np.zeros_like(model.weights, np.float64)
    model.counts(text, counts)
    likelihood = lambda: sum(float(part[3].astype(np.float64).sum()) for part in model.softmaxes(text))
    picked = [tuple(x) for x in np.argwhere(counts > 0)[::37]] + [(int(np.argwhere(counts > 0)[3][0]), 9)]
    for at in picked:
        old, found = model.weights[at], []
        for step in (0.02, -0.02):
            model.weights[at] = old + step
            found.append(likelihood())
        model.weights[at] = old
        assert total[at] == pytest.approx((found[0] - found[1]) / 0.04, abs=2e-2)


def test_classes_hold_each_word_once():
    vocabulary, model, _ = small_model()
    places = set(zip(model.class_of[: lm.TOP].tolist(), model.place_of.tolist()))
    assert len(places) == lm.TOP and max(model.class_of) < lm.UNKNOWN
    assert np.exp(model.classes.astype(float)).sum() == pytest.approx(1.0, abs=1e-5)
    assert np.exp(model.places.astype(float)).sum(1) == pytest.approx(np.ones(lm.CLASSES), abs=1e-4)


def test_sums_of_many_rows_take_few_loops():
    """The gradient's largest part: rows met once are taken as they are, others two columns at a time."""
    import time

    rng = np.random.default_rng(0)
    rows = rng.integers(0, 8192, 4096)
    values = rng.random((4096, lm.SLOTS), dtype=np.float32)
    want = np.zeros((8192, lm.SLOTS))
    np.subtract.at(want, rows, values.astype(np.float64))
    total = np.zeros((8192, lm.SLOTS), np.float32)
    lm.scatter(total, rows, values)
    assert np.abs(total - want).max() < 1e-5

    def plain(total, rows, values):
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total[ordered[first]] -= np.add.reduceat(values.take(order, 0), first, axis=0)

    def least(f):
        took = []
        for _ in range(30):
            began = time.perf_counter()
            f(total, rows, values)
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(lm.scatter) < 0.8 * least(plain)
