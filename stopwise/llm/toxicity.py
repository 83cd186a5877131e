"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: an embedding of its hash and the mean embedding of the hashes of its character
n-grams. The words of a text are read in overlapping windows by two gated recurrent networks, one
in each direction; attention pools their states; the text's score is that of its worst window.
"""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.tables import read, small_batches

ROW_BITS = 17  # of the numbers of rows of both embedding tables
GRAMS = (3, 5)
WIDTH = 8  # of both embeddings
HIDDEN = 8
RARE = 4
ATTENTION = 8
WINDOW = 64
STRIDE = 48
PART = 1024  # windows whose states are kept at once in training
# letters in lower case, blanks for all other ASCII
LETTERS = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256)).lower()


def _row(h: np.ndarray) -> np.ndarray:
    """Row of a table for a 32-bit hash: the high bits of its product with an odd number."""
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - ROW_BITS)).astype(np.int32)


class Words:
    """The distinct words of some texts, with their hashed features, and each text's word numbers.

    Words are runs of letters (any byte beyond ASCII counts as one), with ASCII lower-cased.
    """

    def __init__(self, texts: list[bytes | None]):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        split = [(t or b"").translate(LETTERS).split() for t in texts]
        self.texts = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split]
        self.count = len(number)
        raw = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in number]), np.uint8).astype(np.uint32)
        sizes = np.array([len(w) + 2 for w in number], np.int64)
        owner = np.repeat(np.arange(self.count), sizes)
        grams, owners = [], []
        h = raw + np.uint32(1)
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint32(0x85EBCA6B) + raw[n - 1 :] + np.uint32(1)
            if n in GRAMS:
                inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
                grams.append(_row(h[inside]))
                owners.append(owner[inside])
        self.grams = np.concatenate(grams)
        self.owners = np.concatenate(owners)
        self.per_word = np.maximum(np.bincount(self.owners, minlength=self.count), 1).astype(np.float32)
        self.hashes = _row(np.array([zlib.crc32(w) for w in number], np.uint32))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all windows (-1 where one is shorter), their lengths and their texts.
        A text without words has one empty window."""
        rows, sizes, owners = [], [], []
        for k, ids in enumerate(self.texts):
            last = max(0, -(-(len(ids) - WINDOW) // STRIDE))
            padded = np.full(last * STRIDE + WINDOW, -1, np.int64)
            padded[: len(ids)] = ids
            part = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
            rows.append(part)
            sizes.append((part >= 0).sum(1))
            owners.append(np.full(last + 1, k))
        return np.concatenate(rows), np.concatenate(sizes), np.concatenate(owners)


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0.0, 1.0, out=x)


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign; its slope is (1 - |y|) ** 2."""
    y = np.abs(x)
    y += 1.0
    return np.divide(x, y, out=y)


def _sums(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of the values of equal rows."""
    return np.stack([np.bincount(rows, values[:, i], count) for i in range(values.shape[1])], 1).astype(np.float32)


class Network:
    """Gates are hard sigmoids and the other activations softsigns: both cost a few plain
    operations, and gates can close wholly."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "words": draw(1 << ROW_BITS, WIDTH, scale=0.1),
            "grams": draw(1 << ROW_BITS, WIDTH, scale=0.1),
            "attend": draw(2 * HIDDEN, ATTENTION, scale=0.3),
            "query": draw(ATTENTION, scale=0.3),
            "out": draw(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p[f"in_{way}"] = draw(2 * WIDTH, 3 * HIDDEN, scale=0.3)
            self.p[f"in_bias_{way}"] = np.zeros(3 * HIDDEN, np.float32)
            self.p[f"rec_{way}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of the distinct words, and a zero row for places without a word."""
        x = np.zeros((words.count + 1, 2 * WIDTH), np.float32)
        x[:-1, :WIDTH] = self.p["words"][words.hashes]
        sums = _sums(words.owners, self.p["grams"].take(words.grams, 0), words.count)
        x[:-1, WIDTH:] = sums / words.per_word[:, None]
        return x

    def forward(self, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Logits of windows. ``ids`` points into the rows of ``x``; -1 is a place without a word,
        over which states pass unchanged."""
        n, steps = len(ids), int(sizes.max(initial=0))
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        trace = {}
        for way in "fb":
            gates = x @ self.p[f"in_{way}"] + self.p[f"in_bias_{way}"]
            rec = self.p[f"rec_{way}"]
            h = np.zeros((n, HIDDEN), np.float32)
            side = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
            held = []
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                a = gates.take(ids[:, t], 0)
                b = h @ rec
                zr = _gate(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = _soft(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
                there = (t < sizes)[:, None]
                if keep:
                    held.append((t, h, z, r, c, b[:, 2 * HIDDEN :], there))
                h = h + z * (c - h) * there
                states[t, :, side] = h
            trace[way] = held
        u = _soft(states @ self.p["attend"])
        e = u @ self.p["query"]
        e[np.arange(steps)[:, None] >= sizes[None, :]] = -1e9
        w = np.exp(e - e.max(0, initial=-1e9))
        w *= np.arange(steps)[:, None] < sizes[None, :]
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * states).sum(0)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (states, u, w, pooled, trace)) if keep else logits

    def gradients(self, words: Words, x, ids, sizes, error, kept):
        """Gradients of all parameters for d loss / d logit = ``error``."""
        states, u, w, pooled, trace = kept
        g = {"bias": np.array([error.sum()], np.float32), "out": pooled.T @ error}
        d_pooled = error[:, None] * self.p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = (states * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_u = d_e[:, :, None] * self.p["query"] * (1 - np.abs(u)) ** 2
        g["query"] = np.tensordot(d_e, u, ([0, 1], [0, 1]))
        g["attend"] = np.tensordot(states, d_u, ([0, 1], [0, 1]))
        d_states += d_u @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for way in "fb":
            rec, side = self.p[f"rec_{way}"], slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
            d_rec, d_all = np.zeros_like(rec), []
            d_h = np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, r, c, b, there in reversed(trace[way]):
                d_h = d_h + d_states[t][:, side]
                d = d_h * there
                d_c = d * z * (1 - np.abs(c)) ** 2
                d_z = d * (c - h) * 0.25 * ((z > 0) & (z < 1))
                d_r = d_c * b * 0.25 * ((r > 0) & (r < 1))
                d_all.append(np.concatenate([d_z, d_r, d_c], 1))
                d_b = np.concatenate([d_z, d_r, d_c * r], 1)
                d_rec += h.T @ d_b
                d_h = d_h - d * z + d_b @ rec.T
            order = [t for t, *_ in reversed(trace[way])]
            at = ids[:, order].T.reshape(-1)
            d_gates = _sums(np.where(at < 0, len(x) - 1, at), np.concatenate(d_all), len(x))
            d_gates[-1] = 0
            g[f"rec_{way}"] = d_rec
            g[f"in_{way}"] = x.T @ d_gates
            g[f"in_bias_{way}"] = d_gates.sum(0)
            d_x += d_gates @ self.p[f"in_{way}"].T
        g["words"] = _sums(words.hashes, d_x[:-1, :WIDTH], 1 << ROW_BITS)
        shares = d_x[:-1, WIDTH:] / words.per_word[:, None]
        g["grams"] = _sums(words.grams, shares[words.owners], 1 << ROW_BITS)
        return g

    def logits(self, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of any number of windows, some thousands at a time."""
        parts = [self.forward(x, ids[i : i + 4 * PART], sizes[i : i + 4 * PART]) for i in range(0, len(ids), 4 * PART)]
        return np.concatenate(parts)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Score of every text: the largest of its windows'."""
        if not texts:
            return np.empty(0)
        words = Words(texts)
        x = self.inputs(words)
        ids, sizes, owners = words.windows()
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owners, self.logits(x, ids, sizes))
        return 1 / (1 + np.exp(-best))


def train(texts: list[bytes | None], labels: np.ndarray, epochs: int = 9, batch: int = 64, rate: float = 0.01, least_steps: int = 350, seed: int = 7) -> Network:
    """Rows of the tables that fewer than ``RARE`` of the texts meet stay zero, so that no text is
    told by its rare words. Adam on the log loss, for ``epochs`` passes or at least ``least_steps`` steps; the texts
    without the label weigh three times as much as the others. In the first epochs every window carries its text's label; later only
    the window with the largest logit does, as it alone decides the text's score."""
    net, rng = Network(seed), np.random.default_rng(seed)
    met = {"words": np.zeros(1 << ROW_BITS, int), "grams": np.zeros(1 << ROW_BITS, int)}
    for text in texts:
        words = Words([text])
        met["words"][np.unique(words.hashes)] += 1
        met["grams"][np.unique(words.grams)] += 1
    kept_rows = {k: (v >= RARE)[:, None] for k, v in met.items()}
    for k, rows in kept_rows.items():
        net.p[k] *= rows
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    epochs = max(epochs, -(-least_steps * batch // len(texts)))
    step, warm = 0, max(1, epochs // 3)
    ones = min(max(float(labels.mean()), 0.01), 0.99)
    weights = np.where(labels == 1, 0.25 / ones, 0.75 / (1 - ones)).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            words = Words([texts[i] for i in chosen])
            x = net.inputs(words)
            ids, sizes, owners = words.windows()
            if epoch >= warm:
                logits = net.logits(x, ids, sizes)
                by_text = np.lexsort((-logits, owners))
                top = by_text[np.concatenate([[True], owners[by_text][1:] != owners[by_text][:-1]])]
                ids, sizes, owners = ids[top], sizes[top], owners[top]
            share = weights[chosen][owners] / np.bincount(owners)[owners] / len(chosen)
            grads: dict = {}
            for some in range(0, len(ids), PART):
                part = slice(some, some + PART)
                logits, kept = net.forward(x, ids[part], sizes[part], keep=True)
                error = (1 / (1 + np.exp(-logits)) - labels[chosen][owners[part]]) * share[part]
                new = net.gradients(words, x, ids[part], sizes[part], error.astype(np.float32), kept)
                grads = {k: g + grads[k] for k, g in new.items()} if grads else new
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, g in grads.items():
                g = g * kept_rows[k] if k in kept_rows else g
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                scale = now * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = 1200, epochs: int = 9) -> Network | None:
    """Network fitted on at most ``per_class`` labelled documents of either class: those with the
    smallest hash of their id, never held-out ones.
    Without labelled documents there is none."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen: dict[int, int] = {}
    for kind in (0, 1):
        rows = usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen.update({r["doc_id"]: kind for r in rows.select("doc_id").collect()})
    if not chosen:
        return None
    spark = documents.sparkSession
    ids = spark.createDataFrame(sorted(chosen.items()), "doc_id long, toxic int")
    sample = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    sample = sample.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")

    def fit(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            rows.sort(key=lambda r: (r[0], r[2] or b""))
            net = train([r[2] for r in rows], np.array([r[1] for r in rows], np.float32), epochs)
            for name, values in net.p.items():
                yield pa.RecordBatch.from_pydict(
                    {"name": [name], "shape": pa.array([values.shape], pa.list_(pa.int32())), "raw": [values.tobytes()]}
                )

    # the sample is bounded, so one task of an executor holds it
    fitted = sample.repartition(1).mapInArrow(fit, "name string, shape array<int>, raw binary").collect()
    if not fitted:
        return None
    net = Network()
    net.p = {r["name"]: np.frombuffer(r["raw"], np.float32).reshape(r["shape"]) for r in fitted}
    return net


def score_toxicity(documents: DataFrame, network: Network | None) -> DataFrame:
    """Adds score and predicted to every document; all its columns stay, columns of these
    names are replaced. Without a network all scores are 0.

    Null and empty texts, and texts without letters, have one window without words; texts of any
    length are read whole; repeated rows score alike; an empty table gives an empty result.
    """

    if network is None:
        return documents.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(network.scores([None if t is None else bytes(t) for t in texts]), dtype="float64")

    scored = documents.withColumn("score", score(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit_toxicity(documents, read(spark, sf_dir, "labels"))
    return score_toxicity(documents, network).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
