"""Scores of texts under a hashed maximum-entropy model of words with a class-factored softmax.

The probability of a token is that of its class times that of the token in its class. Both are
softmaxes over the unigram distribution, tilted by the weights of the features of the tokens before
it: the last token, the last two together, and tokens further back, skipping what lies between. Rows
of weights are found by hashing a feature. Frequent words form classes by the company they keep; all
other words form classes by their endings, within which the unigram distribution decides. Without
weights the model is the unigram distribution itself.

Spark counts all tokens and all pairs of feature and class, which give the first weights; then each
round adds up the gradient over its share of the documents. Every training document is in one round.
"""

import functools
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.tables import read, small_batches
from stopwise.workspace import staged

END = b" "  # no word holds a space
KEY_BYTES = 32
WORDS = 1 << 18  # of the dictionary that goes to the tasks; all other words are joined
HELD = 1 << 16  # distinct words counted in a task before they go out

CLASSES = 48
SLOTS = 64
TOP = CLASSES * SLOTS  # words with a class and a place in it
ENDINGS = 1024  # groups of all other words, by their last bytes
TAILS = 15  # classes of these groups
UNKNOWN = CLASSES + TAILS  # the class of words never seen in training
COLUMNS = UNKNOWN + 1
START = TOP + ENDINGS  # stands before the first token
RARE = 1 << 15  # marks a token outside the dictionary
COMPANY = 128
NEVER = np.float32(-1e30)

CLASS_BITS = (13, 12, 13)  # bits of the rows of the features of classes
CLASS_ROWS = sum(1 << b for b in CLASS_BITS)
NEAR = 192  # words that are features of places of their own; others count as their class
CONTEXTS = NEAR + COLUMNS
PLACE_SETS = 2
ROWS = CLASS_ROWS + PLACE_SETS * CLASSES * CONTEXTS
BLOCK = 256  # rows that are added up together
PART = 4096  # tokens whose softmaxes are kept at once
TASK_TOKENS = 1 << 24  # of a task that sends a gradient
ROUNDS = 3
SMOOTH = 8.0
STEP = 0.4
BOUND = np.float32(8)  # of weights
ONES = np.ones(SLOTS, np.float32)


def key_of(token: bytes) -> bytes:
    """The token itself, or a digest of a long one with its last bytes."""
    return token if len(token) <= KEY_BYTES else b" " + hashlib.sha256(token).hexdigest().encode() + token[-3:]


def ending(key: bytes) -> int:
    return zlib.crc32(key[-3:]) % ENDINGS


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()  # both take ASCII letters and ASCII white space only


# ---- counts ----


def token_counts(texts: DataFrame) -> DataFrame:
    """(key, c): how often every token occurs in a table with one binary column, one END a row included."""

    def run(batches):
        held: dict[bytes, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])
            held.clear()
            return out

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held[END] = held.get(END, 0) + 1
                for t in tokens(raw):
                    if t in held:
                        held[t] += 1
                    else:
                        k = t if len(t) <= KEY_BYTES else key_of(t)
                        held[k] = held.get(k, 0) + 1
                if len(held) >= HELD:
                    yield rows()
        yield rows()

    return texts.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The most frequent words with their counts, and what is known of all others."""

    def __init__(self, counts: DataFrame, words: int = WORDS):
        sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = int(sums["n"]), int(sums["v"])
        # words by eighths of a power of two of their counts: the most that fit
        size = F.floor(F.log2("c") * 8)
        least = None
        left = words - 1
        for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
            left -= r["n"]
            if left < 0:
                break
            least = r["size"]
        chosen = F.col("key") == F.lit(END)
        chosen = chosen if least is None else chosen | (size >= least)
        found = counts.where(chosen).toArrow()
        rows = sorted(zip(found["c"].to_pylist(), found["key"].to_pylist()), key=lambda r: (r[1] != END, -r[0], r[1]))
        self.blob = b"\n".join(k for _, k in rows)
        self.counts = np.array([c for c, _ in rows], np.int64)
        # what the groups of endings hold beside the words with a place
        self.mass = np.zeros(ENDINGS)
        group = (F.crc32(F.substring("key", -3, 3)) % ENDINGS).alias("group")
        for r in counts.groupBy(group).agg((F.sum("c") + 0.5 * F.count("*")).alias("mass")).collect():
            self.mass[r["group"]] = r["mass"]
        for c, k in rows[:TOP]:
            self.mass[ending(k)] -= c + 0.5
        self.mass = np.maximum(self.mass, 0.0)

    @property
    def whole(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def words(self) -> list[bytes]:
        return self.blob.split(b"\n") if len(self.counts) else []


@functools.lru_cache(2)
def _numbers(blob: bytes) -> tuple[dict[bytes, int], np.ndarray]:
    """Number of every word of the dictionary, and its id: a place for the first, a group for others."""
    words = blob.split(b"\n")
    ids = np.array([k if k < TOP else TOP + ending(w) for k, w in enumerate(words)], np.uint16)
    return {w: k for k, w in enumerate(words)}, ids


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds to (row, id, held_out, round, text): n_tokens; n_known and base_score of the tokens of the
    dictionary; tail_score, the part of base_score of words without a place; ``ids`` (two bytes a
    token) and ``rare``, the keys of tokens outside the dictionary, in order."""
    whole = vocabulary.whole

    def run(batches):
        numbers, ids_of = _numbers(vocabulary.blob) if len(vocabulary.counts) else ({}, np.zeros(0, np.uint16))
        score = np.log10((vocabulary.counts + 0.5) / whole)
        tail = np.where(ids_of < TOP, 0.0, score)
        get = numbers.get
        for batch in batches:
            out = []
            for raw in batch.column(4).to_pylist():
                words = tokens(raw)
                words.append(END)
                at = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
                rare, groups = [], []
                for k in np.flatnonzero(at < 0).tolist():
                    key = words[k]
                    if len(key) > KEY_BYTES:
                        key = key_of(key)
                        at[k] = get(key, -1)
                        if at[k] >= 0:
                            continue
                    rare.append(key)
                    groups.append(zlib.crc32(key[-3:]) % ENDINGS)
                known = at >= 0
                ids = np.empty(len(at), np.uint16)
                ids[known] = ids_of[at[known]]
                ids[~known] = np.array(groups, np.uint16) + np.uint16(TOP | RARE)
                out.append((len(at), int(known.sum()), float(score[at[known]].sum()), float(tail[at[known]].sum()), ids.astype("<u2").tobytes(), rare))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *arrays],
                names=["row", "id", "held_out", "round", "n_tokens", "n_known", "base_score", "tail_score", "ids", "rare"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    schema = (
        f"row long, id {kind}, held_out boolean, round int, n_tokens long, n_known long, base_score double, tail_score double,"
        " ids binary, rare array<binary>"
    )
    return docs.mapInArrow(run, schema)


def added(docs: DataFrame, tasks: int, measure, rows: int, columns: int) -> np.ndarray:
    """Sum over all tasks of the (rows, columns) matrices that ``measure`` makes of the ids of a batch.
    Blocks of rows are added up by Spark; only the sum, whose size is fixed, reaches the driver."""
    size = BLOCK * columns

    def run(batches):
        total = np.zeros((rows, columns), np.float32)
        for batch in batches:
            measure(Text.of(batch.column(0)), total)
        flat = total.reshape(-1, size)
        used = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([flat[k].tobytes() for k in used], pa.binary())], names=["k", "v"]
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(v, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["k", "v"]
        )

    parts = docs.select("ids").coalesce(tasks).mapInArrow(run, "k int, v binary")
    out = np.zeros((rows * columns // size, size), np.float32)
    for r in parts.repartition("k").mapInArrow(add, "k int, v binary").toLocalIterator():
        out[r["k"]] = np.frombuffer(r["v"], np.float64)
    return out.reshape(rows, columns)


# ---- the model ----


class Text:
    """Tokens of some documents: ids, the two ids before each, and where documents begin."""

    def __init__(self, raw: list[bytes]):
        arrays = [np.frombuffer(r, "<u2") for r in raw]
        both = np.concatenate([*arrays, np.zeros(0, np.uint16)])
        self.rare = (both & RARE) > 0
        self.ids = (both & (RARE - 1)).astype(np.int32)
        lengths = np.array([len(a) for a in arrays], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.before = []
        last = self.ids
        for _ in range(2):
            last = np.concatenate([[START], last[:-1]]).astype(np.int32) if len(last) else last
            last[self.starts] = START
            self.before.append(last)

    @classmethod
    def of(cls, column: pa.Array) -> "Text":
        return cls(column.to_pylist())


def hashed(bits: int, salt: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int64)


def class_rows(text: Text) -> list[np.ndarray]:
    """Rows of weights for the class of every token: n-grams of one and two tokens, and a skip."""
    one, two = text.before
    out, first = [], 0
    for salt, (bits, parts) in enumerate(zip(CLASS_BITS, ((one,), (two,), (one, two))), 1):
        out.append(hashed(bits, salt, *parts) + first)
        first += 1 << bits
    return out




class Model:
    """Classes, unigram distributions and weights."""

    def __init__(self, vocabulary: Vocabulary, company: np.ndarray):
        q = (vocabulary.counts[:TOP] + 0.5) / vocabulary.whole
        mass = vocabulary.mass / vocabulary.whole
        self.unknown = 0.5 / vocabulary.whole
        self.class_of = np.zeros(START, np.int64)
        self.place_of = np.zeros(TOP, np.int64)
        classes = np.zeros(COLUMNS)
        self.places = np.full((CLASSES, SLOTS), NEVER, np.float32)
        like = (company + 4 * company.sum(0) / max(company.sum(), 1)) / (company.sum(1, keepdims=True) + 4)
        groups = parted(np.sqrt(like[: len(q)]), np.arange(len(q)), np.ones(len(q)), -(-len(q) // SLOTS))
        for c, ids in enumerate(groups):
            self.class_of[ids] = c
            self.place_of[ids] = np.arange(len(ids))
            classes[c] = q[ids].sum()
            self.places[c, : len(ids)] = np.log(q[ids] / classes[c])
        tails = parted(np.sqrt(like[TOP:]), np.arange(ENDINGS), mass + 1e-12, TAILS)
        for c, ids in enumerate(tails, CLASSES):
            self.class_of[TOP + ids] = c
            classes[c] = mass[ids].sum()
        classes[UNKNOWN] = self.unknown
        # START goes with the class that no word before can have
        self.context_of = np.append(NEAR + self.class_of, NEAR + UNKNOWN)
        self.context_of[:NEAR] = np.arange(NEAR)
        self.classes = np.where(classes > 0, np.log(np.maximum(classes, 1e-300)), NEVER).astype(np.float32)
        self.weights = np.zeros((ROWS, SLOTS), np.float32)

    def place_rows(self, text: Text, at: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        """Rows of weights for the places in the classes of the tokens ``at``: an n-gram and a skip."""
        first = CLASS_ROWS + classes * CONTEXTS
        return [first + k * CLASSES * CONTEXTS + self.context_of[text.before[k][at]] for k in range(PLACE_SETS)]

    def softmaxes(self, text: Text, keep: bool = False):
        """For every part of the tokens: (from, to, logs of the sums of the class softmax, logs of the
        tokens' probabilities without those of words in tail classes), and with ``keep`` what a
        gradient needs: rows and distributions of both softmaxes."""
        ids = text.ids
        classes, rows = self.class_of[ids], class_rows(text)
        held = np.empty((3, min(PART, len(ids)), SLOTS), np.float32)  # logits of both softmaxes, and rows
        for a in range(0, len(ids), PART):
            b = min(a + PART, len(ids))
            here = [r[a:b] for r in rows]
            c = classes[a:b]
            logit = self.summed(here, held[0], held[2])
            logit += self.classes
            mine = logit[np.arange(b - a), c]
            z = distribution(logit, keep)
            logs = mine - z
            top = np.flatnonzero(ids[a:b] < TOP)
            there = self.place_rows(text, top + a, c[top])
            inner = self.summed(there, held[1], held[2])
            inner += self.places.take(c[top], 0, out=held[2][: len(top)], mode="clip")
            place = self.place_of[ids[a:b][top]]
            mine = inner[np.arange(len(top)), place]
            logs[top] += mine - distribution(inner, keep)
            yield (a, b, z, logs, here, logit, c, there, inner, place) if keep else (a, b, z, logs)

    def summed(self, rows: list[np.ndarray], out: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Sums of the weights of features."""
        n = len(rows[0])
        out, room = out[:n], room[:n]
        self.weights.take(rows[0], 0, out=out, mode="clip")
        for r in rows[1:]:
            out += self.weights.take(r, 0, out=room, mode="clip")
        return out

    def counts(self, text: Text, total: np.ndarray):
        """Adds how often each feature meets each class, and each place."""
        classes = self.class_of[text.ids]
        top = np.flatnonzero(text.ids < TOP)
        pairs = [r * SLOTS + classes for r in class_rows(text)]
        pairs += [r * SLOTS + self.place_of[text.ids[top]] for r in self.place_rows(text, top, classes[top])]
        total += np.bincount(np.concatenate(pairs), minlength=total.size).reshape(total.shape)

    def gradient(self, text: Text, total: np.ndarray):
        """Adds the gradient of the texts' log probability."""
        for _, _, _, _, rows, p, c, there, inner, place in self.softmaxes(text, keep=True):
            p[np.arange(len(p)), c] -= 1
            for r in rows:
                scatter(total, r, p)
            inner[np.arange(len(inner)), place] -= 1
            for r in there:
                scatter(total, r, inner)

    def start(self, counts: np.ndarray):
        """Weights from counts: each feature alone would give its own distribution; they share the say."""
        q = np.exp(self.classes.astype(np.float64))[None]
        inner = np.exp(self.places.astype(np.float64))
        parts = [(a, min(a + PART, CLASS_ROWS), q, len(CLASS_BITS)) for a in range(0, CLASS_ROWS, PART)]
        for k in range(PLACE_SETS * CLASSES):
            first, c = CLASS_ROWS + k * CONTEXTS, k % CLASSES
            parts.append((first, first + CONTEXTS, inner[c : c + 1], PLACE_SETS))
        for a, b, q, share in parts:
            n = counts[a:b]
            seen = n.sum(1, keepdims=True)
            ratio = (n + SMOOTH * q) / ((seen + SMOOTH) * np.maximum(q, 1e-300))
            self.weights[a:b] = np.clip(np.where(q > 0, np.log(np.maximum(ratio, 1e-9)) / share, 0), -BOUND, BOUND)
        self.weights[:CLASS_ROWS, UNKNOWN] = 0

    def step(self, counts: np.ndarray, gradient: np.ndarray):
        """A step along the gradient, scaled by how often pairs were met and expected."""
        for a in range(0, ROWS, PART):
            n, g = counts[a : a + PART], gradient[a : a + PART]
            move = STEP * g / ((n + np.maximum(n - g, 0)) / 2 + SMOOTH)
            self.weights[a : a + PART] = np.clip(self.weights[a : a + PART] + move, -BOUND, BOUND)
        self.weights[:CLASS_ROWS, UNKNOWN] = 0


def distribution(logit: np.ndarray, keep: bool) -> np.ndarray:
    """Logs of the sums of the rows of logits' exponentials. These are at most a few times BOUND, so
    none overflows. With ``keep`` the rows become probabilities, in place; else they are used up."""
    np.exp(logit, out=logit)
    total = logit @ ONES
    if keep:
        logit /= total[:, None]
    return np.log(total)


def scatter(total: np.ndarray, rows: np.ndarray, values: np.ndarray):
    """Takes the values from the rows of the total."""
    if len(rows):
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # by counting: there are fewer rows than 2**16
        ordered = rows[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
        once = new[:-1] & new[1:]
        total[ordered[once]] -= values.take(order[once], 0)
        many = ~once
        first = np.flatnonzero(new[:-1][many])
        if len(first):
            # neighbours in a row are added as one complex number, in half as many loops
            pairs = values.take(order[many], 0).view(np.complex64)
            total[ordered[many][first]] -= np.add.reduceat(pairs, first, axis=0).view(np.float32)


def parted(vectors: np.ndarray, ids: np.ndarray, weight: np.ndarray, parts: int) -> list[np.ndarray]:
    """The ids in groups of about equal weight and like vectors, by halving along the widest direction."""
    if parts <= 1 or len(ids) <= 1:
        return [ids] * (len(ids) > 0)
    centred = vectors[ids] - np.average(vectors[ids], axis=0, weights=weight[ids])
    _, _, ways = np.linalg.svd((centred * np.sqrt(weight[ids] / weight[ids].max())[:, None]).T @ centred)
    order = np.argsort(centred @ ways[0], kind="stable")
    half = parts // 2
    if (weight == 1).all():  # groups of SLOTS words
        cut = half * SLOTS
    else:
        gone = np.cumsum(weight[ids[order]])
        cut = min(max(int(np.searchsorted(gone, gone[-1] * half / parts)), 1), len(ids) - 1)
    return parted(vectors, ids[order[:cut]], weight, half) + parted(vectors, ids[order[cut:]], weight, parts - half)


def company(text: Text, total: np.ndarray):
    """Adds how often each id follows, one or two places on, each of the most frequent words."""
    for before in text.before[:2]:
        pair = text.ids.astype(np.int64) * COMPANY + np.minimum(before, COMPANY - 1)
        total += np.bincount(pair, minlength=total.size).reshape(total.shape)


def fitted(train: DataFrame, vocabulary: Vocabulary, total_tokens: int, rounds: int = ROUNDS) -> Model:
    """The model from encoded training documents with column ``round``."""
    tasks = max(1, -(-total_tokens // TASK_TOKENS))
    model = Model(vocabulary, added(train, tasks, company, START, COMPANY))
    counts = added(train, tasks, model.counts, ROWS, SLOTS)
    model.start(counts)
    for k in range(rounds):
        share = train.where(F.col("round") == k)
        model.step(counts / np.float32(rounds), added(share, tasks, model.gradient, ROWS, SLOTS))
    return model


def scored(docs: DataFrame, model: Model, vocabulary: Vocabulary) -> DataFrame:
    """(row, id, held_out, n_tokens, n_known, base_score, score, rare): of the tokens in the
    dictionary, and for each other token its key, what its class gives it if it is known beside its
    unigram probability, and what it has if it is not."""
    ten = np.log(10)

    def run(batches):
        unigram = np.log(np.maximum(np.exp(model.classes.astype(np.float64)), 1e-300))
        for batch in batches:
            text = Text.of(batch.column(6))
            n = len(text.ids)
            logs, z = np.zeros(n), np.zeros(n)
            for a, b, sums, part in model.softmaxes(text):
                logs[a:b], z[a:b] = part, sums
            tail = text.ids >= TOP
            logs[tail] -= unigram[model.class_of[text.ids[tail]]]  # beside the word's own unigram log
            known = np.where(text.rare, 0.0, logs) / ten
            sums = np.add.reduceat(known, text.starts) if n else np.zeros(0)
            rare = np.flatnonzero(text.rare)
            inside = logs[rare] / ten
            outside = (np.log(model.unknown) - z[rare]) / ten
            lists = batch.column(7)
            pairs = pa.StructArray.from_arrays(
                [lists.flatten(), pa.array(inside.astype(np.float32)), pa.array(outside.astype(np.float32))], names=["key", "inside", "outside"]
            )
            ends = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))
            score = sums + batch.column(8).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(score), pa.ListArray.from_arrays(ends, pairs)],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    schema = (
        f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double,"
        " rare array<struct<key:binary,inside:float,outside:float>>"
    )
    columns = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "ids", "rare", "tail_score"]
    return docs.select(*columns).mapInArrow(run, schema)


def language_scores(
    documents: DataFrame, held_out: Column, deal: Column, id_column: str = "doc_id", text_column: str = "text",
    rounds: int = ROUNDS, words: int = WORDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    The model learns from the rows for which ``held_out`` is not true; ``deal``, a whole number, deals
    these to the rounds. A null text counts as empty and has the end token only; repeated rows are
    documents of their own; null ids stay. Without training rows all tokens are unknown and share one
    probability, 1. An empty table gives an empty result. Other columns of the input are not read.
    ``words`` bounds the dictionary that goes to the tasks; while it holds the words that have a place
    (``TOP``), it changes the way and not the figures.
    """
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.pmod(F.coalesce(deal, F.lit(0)), F.lit(rounds)).cast("int").alias("round"),
        F.col(text_column).cast("binary").alias("text"),
    )
    counts = staged(token_counts(docs.where("NOT held_out").select("text")), "token-counts")
    vocabulary = Vocabulary(counts, words)
    docs = staged(encoded(docs, vocabulary), "encoded")
    model = fitted(docs.where("NOT held_out"), vocabulary, vocabulary.n, rounds)
    found = staged(scored(docs, model, vocabulary), "scored")
    one = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(vocabulary.whole))
    rare = found.select("row", F.explode("rare").alias("t")).select("row", "t.*")
    rare = rare.join(counts, "key", "left").groupBy(F.col("row").alias("_row")).agg(
        F.count("c").alias("_known"),
        F.sum(one).alias("_base"),
        F.sum(F.when(F.col("c").isNull(), F.col("outside")).otherwise(F.col("inside") + one)).alias("_score"),
    )
    whole = found.join(rare, F.col("row") == F.col("_row"), "left")
    return whole.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return language_scores(documents, digest % 5 == 1, F.floor(digest / 5))
