"""Whitening against plain numpy."""

import math

import numpy as np
import pytest

from stopwise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in good]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(sums) / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    out = {}
    for (i, _), row in zip(good, x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        for k in range(components):
            e, u = values[-1 - k], vectors[:, -1 - k]
            out[i, k + 1] = (n, deviation, float((np.array(row) - np.array(sums) / n) @ u / np.sqrt(e)), e / np.trace(v))
    return out


def test_same_as_numpy(spark):
    rng = np.random.default_rng(3)
    shape = rng.standard_normal((6, 10)) * np.array([3, 2, 1, 0.5, 0.2, 0.1])[:, None]
    vectors = (rng.standard_normal((300, 6)) @ shape + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # repeated vectors count once
    rows += [(2000, None), (2001, [None] + rows[1][1][1:]), (2002, [float("inf")] + rows[1][1][1:]), (2003, [float("nan")] * 10)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(7)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    sign = {k: np.sign(got[0, k].whitened * want[0, k][2]) for k in range(1, 5)}
    for key, (n, deviation, whitened, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(sign[key[1]] * whitened, abs=1e-9)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_odd_vectors(spark):
    def run(rows, schema=SCHEMA):
        return whitening.whiten(spark.createDataFrame(rows, schema)).collect()

    assert run([]) == [] and run([(1, None, 0), (2, [], 0)]) == []
    alike = run([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])
    assert len(alike) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alike} == {
        (1, 0, None, 0.0, None)
    }
    short = run([(1, [1.0, 0.0], 0), (2, [1.0], 0), (3, [-0.001, 1.0], 0)])
    assert {r.n for r in short} == {2}
    large = run([(1, [1e300], 0), (2, [-3e5], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(r.whitened for r in large) == pytest.approx([-1, 1])
    line = run([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(50)])
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))][:3] == [False, True, True]


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    for matrix in (
        (lambda a: a @ a.T)(rng.standard_normal((n, n))),
        np.eye(n),
        np.zeros((n, n)),
        np.diag(np.repeat([5.0, 1.0], [n - n // 2, n // 2])),  # many equal eigenvalues
        np.ones((n, n)) * 1e-12,
    ):
        k = min(n, 6)
        values, vectors = whitening.principal(matrix, k)
        size = np.abs(matrix).max() or 1.0
        assert np.allclose(values / size, np.linalg.eigvalsh(matrix)[::-1][:k] / size, atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
        assert np.allclose(matrix @ vectors / size, vectors * values / size, atol=1e-10)
