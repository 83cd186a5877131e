"""Whitening of embeddings by their principal components.

Spark sums counts, totals and the centred covariance over the distinct vectors. The covariance, whose
size is that of one vector squared, is diagonalised in numpy: Householder reflections make it
tridiagonal, Sturm counts bisect its leading eigenvalues, and inverse iteration, with
reorthogonalisation inside clusters, gives their vectors. The projection goes out to all rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.tables import read
from stopwise.workspace import staged

SCALE = 256
LIMIT = float(1 << 62)  # x is held within it, so that it fits a long


# ---- eigenvectors of a symmetric matrix ----


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors: reflections H1, H2, ... make the matrix tridiagonal."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        v = np.zeros(n - k - 1)
        if scale > 0:
            v = x / scale
            norm = np.sqrt(v @ v)
            v[0] += norm if v[0] >= 0 else -norm
            v /= np.sqrt(v @ v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (p @ v) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            x -= 2 * v * (v @ x)
            a[k, k + 1 :] = x
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def reflected(reflectors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Columns of the tridiagonal matrix's space, carried back to the matrix's own."""
    out = vectors.copy()
    for v in reversed(reflectors):
        part = out[len(out) - len(v) :]
        part -= 2 * np.outer(v, v @ part)
    return out


def above(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie above each point."""
    q = diagonal[0] - points
    count = (q > 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - points - e * e / q
        count += q > 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected until no double lies between its ends."""
    around = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    size = max(float((np.abs(diagonal) + around).max()), 1.0)
    low, high = np.full(count, -size * 1.01), np.full(count, size * 1.01)
    tiny = size * np.finfo(float).eps ** 2
    rank = np.arange(1, count + 1)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low < size * 1e-18)).all():
            return middle
        more = above(diagonal, off, middle, tiny) >= rank
        low, high = np.where(more, middle, low), np.where(more, high, middle)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - shift) y = right by elimination with row exchanges."""
    n = len(diagonal)
    a, b, c = diagonal - shift, np.append(off, 0.0), np.zeros(n)  # of the current rows: three diagonals
    y = right.copy()
    for k in range(n - 1):
        low, below, next_ = off[k], a[k + 1], b[k + 1]
        if abs(low) > abs(a[k]):
            top, over = a[k], b[k]
            a[k], b[k], c[k] = low, below, next_
            y[k], y[k + 1] = y[k + 1], y[k]
            factor = top / low
            a[k + 1], b[k + 1] = over - factor * below, -factor * next_
        else:
            if abs(a[k]) < tiny:
                a[k] = tiny
            factor = low / a[k]
            a[k + 1] = below - factor * b[k]
        y[k + 1] -= factor * y[k]
    for k in range(n - 1, -1, -1):
        pivot = a[k] if abs(a[k]) >= tiny else tiny
        later = (b[k] * y[k + 1] if k + 1 < n else 0.0) + (c[k] * y[k + 2] if k + 2 < n else 0.0)
        y[k] = (y[k] - later) / pivot
        if abs(y[k]) > 1e100:  # only the direction matters
            y *= 1e-100
    return y


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of falling eigenvalues. Values closer than a thousandth of the
    norm are a cluster, whose vectors are made orthogonal to each other in every iteration."""
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), 1.0)
    tiny = size * np.finfo(float).eps
    rng = np.random.default_rng(11)
    found = np.zeros((n, len(values)))
    start, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            start = k
        # equal values take shifts a little apart
        shift = min(value, shift - 4 * tiny) if k > start else value
        y = rng.standard_normal(n)
        cluster = found[:, start:k]
        for _ in range(6):
            y = solved(diagonal, off, shift, y / np.sqrt(y @ y), tiny)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= cluster @ (cluster.T @ y)
            y /= np.sqrt(y @ y)
        found[:, k] = y
    return found


def principal(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = float(np.abs(covariance).max()) or 1.0
    diagonal, off, reflectors = tridiagonal(covariance / size)
    values = leading_values(diagonal, off, count)
    vectors = reflected(reflectors, eigenvectors(diagonal, off, values))
    return values * size, vectors / np.sqrt((vectors**2).sum(0))


# ---- sums over all vectors ----


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of longs as bytes: the width of its numbers, the least that holds the row, then the numbers."""
    most = np.maximum(x.max(1, initial=0), ~x.min(1, initial=0))
    widths = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    out: list[bytes] = [b""] * len(x)
    for width in (2, 4, 8):
        rows = np.flatnonzero(widths == width)
        part = np.ascontiguousarray(x[rows].astype(f"<i{width}"))
        for row, numbers in zip(rows.tolist(), part):
            out[row] = bytes([width]) + numbers.tobytes()
    return out


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """The longs of packed rows. Rows of one width are read together."""
    out = np.zeros((len(rows), width), np.int64)
    kinds = np.array([r[0] for r in rows], np.int64)
    for kind in (2, 4, 8):
        at = np.flatnonzero(kinds == kind)
        if len(at):
            raw = b"".join([rows[k][1:] for k in at.tolist()])
            out[at] = np.frombuffer(raw, f"<i{kind}").reshape(-1, width)
    return out


def quantised(vectors: DataFrame, width: int) -> DataFrame:
    """(id, x) of rows (id, c) whose vector is wholly finite: x = floor(256 c), shorter vectors filled with 0."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            flat = lists.flatten().cast(pa.float64())
            numbers = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(good)
            lengths = (ends[1:] - ends[:-1])[at]
            x = np.zeros((len(at), width))
            inside = np.arange(width) < lengths[:, None]
            x[inside] = numbers[np.repeat(ends[:-1][at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(packed(x.astype(np.int64)), pa.binary())], names=["id", "x"]
            )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, x binary")


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension. Sums of a batch go out as high and low halves, so that no sum wraps."""

    def run(batches):
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), width)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array(np.full(width, len(x)))],
                names=["k", "high", "low", "n"],
            )

    sums = fit.select("x").mapInArrow(run, "k long, high long, low long, n long").groupBy("k")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    rows = sorted(sums.agg(*exact).collect())
    return (int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]) if rows else (0, [0] * width)


def covariance(fit: DataFrame, n: int, size: int, centred) -> np.ndarray:
    """Sum of the products of centred rows, over n. ``centred`` makes a (rows, size) matrix of packed rows.
    A task gives one row for each row of the matrix; they are added by row."""

    def run(batches):
        sums = np.zeros((size, size))
        for batch in batches:
            y = centred(batch.column(0).to_pylist())
            sums += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "v"]
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0.0) + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["k", "v"]
        )

    schema = "k long, v array<double>"
    parts = fit.select("x").mapInArrow(run, schema).repartition("k").mapInArrow(add, schema)
    out = np.zeros((size, size))
    for r in parts.collect():
        out[r["k"]] = r["v"]
    return out / n


def whiten(
    embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row with a wholly
    finite vector and every component, numbered from 1.

    Rows whose vector is null or holds null or non-finite entries go. Shorter vectors count as filled
    with zeros; entries beyond 2**54 count as 2**54. Repeated vectors count once in the covariance but
    have rows of their own, null ids too. ``deviation`` is exact; beyond a long it wraps. A vector
    space of fewer dimensions has fewer components. A component along which all vectors are alike has
    whitened null, explained 0 and no part in identity_error (null if there is no other). Without
    vectors the result is empty. Other columns of the input are not read.
    """
    narrow = embeddings.select(F.col(id_column).alias("id"), F.col(vector_column).alias("c"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    width = narrow.agg(F.max(F.size("c"))).first()[0] or 0
    rows = staged(quantised(narrow, max(width, 0)), "vectors")
    fit = staged(rows.select("x").distinct(), "distinct-vectors")
    n, sums = totals(fit, width) if width > 0 else (0, [])
    if n == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    whole = np.array([s // n for s in sums], np.int64)
    mean = np.array([s % n / n for s in sums])  # of what is left beside the whole part: no digit is lost

    def centred(packed_rows):
        return (unpacked(packed_rows, width) - whole).astype(np.float64) - mean

    v = covariance(fit, n, width, centred)
    trace = float(np.trace(v))
    count = min(components, width)
    values, vectors = principal((v + v.T) / 2, count)
    real = values > trace * width * np.finfo(float).eps
    projection = vectors / np.sqrt(np.where(real, values, 1.0))
    # the mean of projected vectors is 0 but for rounding
    check = covariance(fit, n, count, lambda packed_rows: centred(packed_rows) @ projection)[np.ix_(real, real)]
    error = float(np.abs(check - np.eye(int(real.sum()))).max()) if real.any() else None
    explained = np.where(real, values, 0.0) / (trace or 1.0)
    # longs that wrap as sums of products do
    n_wrapped, s_wrapped = np.int64(n), np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)

    def run(batches):
        for batch in batches:
            x_rows = batch.column(1).to_pylist()
            m = len(x_rows)
            with np.errstate(over="ignore"):
                deviation = ((unpacked(x_rows, width) * n_wrapped - s_wrapped) ** 2).sum(1)
            whitened = (centred(x_rows) @ projection).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n)),
                    pa.array(np.repeat(deviation, count)),
                    pa.array(whitened, mask=np.tile(~real, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * count), pa.float64()),
                ],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
