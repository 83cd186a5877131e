"""Removal of long repeated byte strings by sampled, range-partitioned suffixes.

A full suffix array of a corpus is many times its size. Instead every string of ``length`` bytes
names an anchor inside itself, the gram of GRAM bytes with the smallest hash, so equal strings have
equal anchors at equal places, and about one position in 85 is an anchor. The stretch of strings
with one anchor is a run.

1. Grams that anchor more than one run are counted; a Bloom filter of them goes to the tasks, which
   write only runs whose gram may come again.
2. Runs that are equal as a whole are counted by a 128-bit hash; all their strings are repeated.
3. Runs that share a gram but are not equal are range-partitioned by the gram they lead to, with
   splitters that Spark samples. Each bucket sorts the suffixes of its runs by multikey quicksort,
   eight bytes a step, and equal neighbours are repeated strings. A gram with more than GROUP_RUNS
   different runs would fill a bucket; its suffixes are compared across all buckets by hash.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import bloom
from stopwise.llm.tables import read, small_batches
from stopwise.workspace import staged

GRAM = 32
HASHES = 4
PLACE_BITS = 26
CHUNK = 1 << 21
SORT_ROWS = 8_000
GROUP_RUNS = 20_000


def _scrambled(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """Hash of the gram at every place, by doubling."""
    table = _scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h, base, step = table[buffer], 0x9E3779B97F4A7C15 | 1, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), step * 2
    return _scrambled(h)


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(buffer: np.ndarray, text: np.ndarray, length: int):
    """(first, last, anchor, gram) of all runs: strings that start at first to last have the anchor.
    ``text`` numbers the text that each byte belongs to; strings across texts are left out."""
    none = np.empty(0, np.int64)
    if len(buffer) < length:
        return none, none, none, np.empty(0, np.uint64)
    grams = gram_hashes(buffer)
    place = np.arange(len(grams), dtype=np.uint64)
    keyed = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    anchor = window_minimum(keyed, length - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)
    anchor = anchor.astype(np.int64)
    anchor[text[: len(anchor)] != text[length - 1 :]] = -1
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    ends = np.concatenate([starts[1:], [len(anchor)]]) - 1
    kept = anchor[starts] >= 0
    first, last = starts[kept], ends[kept]
    at = anchor[first]
    return first, last, at, grams[at]


def chunks(raws: list[bytes | None], length: int):
    """Groups of texts, as (buffer, text number of each byte, start of each text's bytes, their
    offset in the text, numbers). A text longer than a chunk comes in parts that overlap."""
    held, size = [], 0
    for number, raw in enumerate(raws):
        raw = raw or b""
        step = CHUNK * 8
        for at in range(0, max(1, len(raw) - length + 1), step):
            part = raw[at : at + step + length - 1]
            if len(part) < length:
                continue
            held.append((number, at, part))
            size += len(part)
            if size >= CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.array([len(p) for _, _, p in held])
    buffer = np.frombuffer(b"".join([p for _, _, p in held]), np.uint8)
    text = np.repeat(np.arange(len(held)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return buffer, text, starts, np.array([a for _, a, _ in held]), np.array([n for n, _, _ in held])


def repeated_grams(rows: DataFrame, length: int) -> DataFrame:
    """(h): hashes of the grams that anchor more than one run."""

    def run(batches):
        for batch in batches:
            for buffer, text, *_ in chunks(batch.column(0).to_pylist(), length):
                grams = runs(buffer, text, length)[3]
                h, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    counts = rows.select("raw").mapInArrow(run, "h long, n int")
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def filter_of(keys: DataFrame, bits_per_key: int, limit_bytes: int) -> tuple[int, np.ndarray]:
    """Bloom filter of column ``h``, put together by Spark; at most ``limit_bytes`` come back."""
    size = bloom.size_for(keys.count(), bits_per_key, limit_bytes)
    cells = keys.select(F.explode(F.array_distinct(F.array(*bloom.cells(F.col("h"), size, HASHES)))).alias("cell"))
    words = np.zeros(size // 64, np.uint64)
    for row in bloom.filter_pages(cells, size).toLocalIterator():
        at = row["page"] * bloom.WORDS
        words[at : at + bloom.WORDS] = np.array(row["words"], np.int64).view(np.uint64)
    return size, words


RUN = "id long, mark long, first long, last long, place int, gram long, r1 long, r2 long, content binary"


def without_periods(raw, text, first, last, anchor, gram, length: int):
    """Which runs to keep, and stretches (first, last) of strings that repeat each other.

    In bytes of a short period every period is a run, each equal to the one before. The first two of
    such runs speak for the others, whose strings are repeated whatever else there is.
    """
    same = np.zeros(len(first), bool)  # like the run before, one step on
    step = np.diff(first)
    same[1:] = (gram[1:] == gram[:-1]) & (step == np.diff(anchor)) & (step == np.diff(last)) & (text[first[1:]] == text[first[:-1]])
    same[1:] &= step <= length - GRAM
    same[2:] &= ~same[1:-1] | (step[1:] == step[:-1])
    kept, sure = np.ones(len(first), bool), []
    edges = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        if b - a < 2:
            continue
        # runs a - 1 to b - 1; equal as the bytes under them have this period
        start, end, period = int(first[a - 1]), int(last[b - 1]) + length, int(first[a] - first[a - 1])
        if raw[start : end - period] == raw[start + period : end]:
            kept[a + 1 : b] = False
            sure.append((int(first[a + 1]), int(last[b - 1])))
    return kept, np.array(sure, np.int64).reshape(-1, 2)


def possible_runs(rows: DataFrame, size: int, words: np.ndarray, length: int) -> DataFrame:
    """Runs whose gram is in the filter, with the hash and the bytes of their strings."""

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(1), batch.column(2)
            for buffer, text, starts, offsets, numbers in chunks(batch.column(0).to_pylist(), length):
                first, last, anchor, gram = runs(buffer, text, length)
                kept = bloom.holds(size, words, gram, HASHES)
                first, last, anchor, gram = first[kept], last[kept], anchor[kept], gram[kept]
                if not len(first):
                    continue
                raw = buffer.tobytes()
                kept, sure = without_periods(raw, text, first, last, anchor, gram, length)
                first, last, anchor, gram = first[kept], last[kept], anchor[kept], gram[kept]
                content = [raw[a : b + length] for a, b in zip(first.tolist(), last.tolist())]
                digests = b"".join([xxhash.xxh3_128_digest(c) for c in content])
                both = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
                part = text[first]
                shift = offsets[part] - starts[part]
                taken = pa.array(numbers[part])
                if len(sure):
                    part = text[sure[:, 0]]
                    shift2 = offsets[part] - starts[part]
                    whose, none = pa.array(numbers[part]), [pa.nulls(len(sure), k) for k in (pa.int32(), *[pa.int64()] * 3, pa.binary())]
                    ends = [pa.array(sure[:, k] + shift2) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([ids.take(whose), marks.take(whose), *ends, *none], names=[c.split()[0] for c in RUN.split(", ")])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(taken),
                        marks.take(taken),
                        pa.array(first + shift),
                        pa.array(last + shift),
                        pa.array((anchor - first).astype(np.int32)),
                        pa.array(gram.view(np.int64)),
                        pa.array(both[:, 0].copy()),
                        pa.array(both[:, 1].copy()),
                        pa.array(content, pa.binary()),
                    ],
                    names=[c.split()[0] for c in RUN.split(", ")],
                )

    return rows.select("raw", "id", "mark").mapInArrow(run, RUN)


def equal_suffixes(gram: np.ndarray, place: np.ndarray, content: list[bytes], length: int):
    """For every run, which of its strings equal a string of another run.

    All strings start in classes by gram and distance to the anchor; multikey quicksort splits the
    classes by the next eight bytes, step by step, and drops strings that are alone.
    """
    sizes = np.array([len(c) for c in content])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(content)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    raw = np.frombuffer(b"".join(content) + bytes(8), np.uint8)
    at = starts[owner] + offset
    alive = np.arange(len(at))
    group = _classes(gram[owner].astype(np.int64), (place[owner] - offset).astype(np.int64))
    for step in range(0, length, 8):
        alive, group = _shared(alive, group)
        if not len(alive):
            break
        step = min(step, length - 8)
        token = np.lib.stride_tricks.sliding_window_view(raw, 8)[at[alive] + step]
        token = np.ascontiguousarray(token).view(">u8").reshape(-1).astype(np.uint64)
        group = _classes(group, token.view(np.int64))
    alive, _ = _shared(alive, group)
    repeated = np.zeros(len(at), bool)
    repeated[alive] = True
    return np.split(repeated, np.cumsum(count)[:-1])


def _classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    new = np.concatenate([[False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    classes = np.empty(len(a), np.int64)
    classes[order] = np.cumsum(new)
    return classes


def _shared(alive: np.ndarray, group: np.ndarray):
    kept = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.empty(0, bool)
    return alive[kept], group[kept]


def stretches(repeated: np.ndarray) -> list[int]:
    """Starts and ends (inclusive) of the stretches of True, one after the other."""
    edges = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1], 1).reshape(-1).tolist()


def compare_buckets(unequal: DataFrame, length: int) -> DataFrame:
    """(r1, r2, spans) of the repeated strings of runs with gram, place and content. Spark samples
    the splitters; all runs of a gram are in one bucket."""

    def run(batches):
        held: list[tuple] = []

        def settle(rows):
            spans = equal_suffixes(
                np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[4] for r in rows], length
            )
            return _rows([(r[2], r[3], stretches(s)) for r, s in zip(rows, spans)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= SORT_ROWS and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    ordered = unequal.select("gram", "place", "r1", "r2", "content")
    ordered = ordered.repartitionByRange("gram").sortWithinPartitions("gram", "r1", "r2")
    return ordered.mapInArrow(run, "r1 long, r2 long, spans array<int>")


def _rows(rows):
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["r1", "r2", "spans"])


def compare_across(large: DataFrame, length: int) -> DataFrame:
    """(r1, r2, spans) for runs of grams too frequent for one bucket: their strings are spread over
    all tasks by hash, and equal strings have equal hashes."""

    def run(batches):
        for batch in batches:
            for r1, r2, content in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(content) - length + 1
                digests = b"".join([xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)])
                both = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r1)), pa.array(np.full(n, r2)), pa.array(np.arange(n, dtype=np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    names=["r1", "r2", "at", "s1", "s2"],
                )

    strings = large.select("r1", "r2", "content").mapInArrow(run, "r1 long, r2 long, at int, s1 long, s2 long")
    common = strings.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("s1", "s2")
    found = strings.join(common, ["s1", "s2"]).groupBy("r1", "r2").agg(F.collect_list("at").alias("at"))
    return found.select(
        "r1", "r2", F.flatten(F.transform("at", lambda i: F.array(i, i))).alias("spans")
    )


def removal_spans(rows: DataFrame, length: int) -> DataFrame:
    """(id, mark, spans): starts and ends of repeated strings of every text that has some."""
    grams = staged(repeated_grams(rows, length), "repeated-grams")
    size, words = filter_of(grams, 10, 1 << 26)
    everything = staged(possible_runs(rows, size, words, length), "possible-runs")
    possible = everything.where("content IS NOT NULL")
    sure = everything.where("content IS NULL").select("id", "mark", F.array("first", "last").alias("s"))
    kinds = possible.groupBy("gram", "r1", "r2").agg(F.count("*").alias("n"), F.first("place").alias("place"))
    kinds = staged(kinds, "run-kinds")
    several = kinds.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("k"), F.min("n").alias("least"))
    several = several.where("k > 1 AND least = 1").select("_gram")
    # one run of every kind, for grams with a run that has no equal
    chosen = kinds.join(several, F.col("gram") == F.col("_gram"), "left_semi").select(
        F.col("r1").alias("_1"), F.col("r2").alias("_2")
    )
    same = (F.col("r1") == F.col("_1")) & (F.col("r2") == F.col("_2"))
    unequal = possible.join(chosen, same, "left_semi").groupBy("gram", "r1", "r2").agg(
        F.first("place").alias("place"), F.first("content").alias("content")
    )
    unequal = staged(unequal, "unequal-runs")
    large = unequal.groupBy(F.col("gram").alias("_gram")).count().where(F.col("count") > GROUP_RUNS)
    large = staged(large.select("_gram"), "frequent-grams")
    is_large = F.col("gram") == F.col("_gram")
    within = compare_buckets(unequal.join(large, is_large, "left_anti"), length).where("size(spans) > 0")
    across = compare_across(unequal.join(large, is_large, "left_semi"), length)
    partly = within.unionByName(across).join(
        kinds.where("n = 1").select(F.col("r1").alias("_1"), F.col("r2").alias("_2")), same, "left_semi"
    )
    wholly = kinds.where("n > 1").select("r1", "r2", F.lit(None).cast("array<int>").alias("spans"))
    repeated = staged(wholly.unionByName(partly).select(F.col("r1").alias("_1"), F.col("r2").alias("_2"), "spans"), "repeated-runs")
    whole = F.array(F.lit(0).cast("long"), F.col("last") - F.col("first"))
    spans = F.coalesce(F.col("spans").cast("array<long>"), whole)
    found = possible.select("id", "mark", "first", "last", "r1", "r2").join(repeated, same)
    found = found.select("id", "mark", F.transform(spans, lambda x: x + F.col("first")).alias("s"))
    return found.unionByName(sure).groupBy("id", "mark").agg(F.flatten(F.collect_list("s")).alias("spans"))


def remove_repeats(
    documents: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every document; ``kept`` is the
    bytes that remain.

    A byte goes if a string of ``length`` bytes over it starts at any second place. Texts are UTF-8
    bytes; null counts as empty, and shorter texts stay whole; repeated rows remove each other; rows
    with null ids are treated like others; an empty table gives an empty result. Other columns of the
    input are not read.
    """
    rows = documents.select(
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("raw"), F.col(id_column).cast("long").alias("id")
    ).withColumn("mark", F.xxhash64("raw"))
    spans = removal_spans(rows, length).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    joined = rows.join(spans, rows["id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark")), "left")

    def run(batches):
        for batch in batches:
            out = [_kept(raw, s, length) for raw, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n, removed, parts, sums, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    done = joined.select("id", "raw", "spans").mapInArrow(
        run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return done.withColumnRenamed("id", id_column)


def _kept(raw: bytes, spans: list[int] | None, length: int):
    if not spans:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    kept, at, removed, parts = [], 0, 0, 0
    pairs = sorted(zip(spans[::2], spans[1::2]))
    start, end = pairs[0][0], pairs[0][1] + length
    for a, b in pairs[1:] + [(len(raw) + 1, 0)]:
        if a <= end:
            end = max(end, b + length)
            continue
        kept.append(raw[at:start])
        removed, parts, at = removed + end - start, parts + 1, end
        start, end = a, b + length
    kept.append(raw[at:])
    rest = b"".join(kept)
    return len(raw), removed, parts, hashlib.sha256(rest).hexdigest(), rest


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
