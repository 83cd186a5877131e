"""Benchmark decontamination by greedy string tiling (Wise's running Karp-Rabin matching).

Texts become sequences of words. A rolling hash over windows of the minimum match length joins
documents with the test items that share a window (the seeds). For every such pair, tiles are
chosen longest first: the search length starts at the longest possible match and is lowered step by
step; at each length the hashes of unmarked windows of the item are looked up in the document,
matches are extended, and non-overlapping ones are marked. The share of the item's words under tiles
is its coverage, however the passages were ordered.
"""

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.tables import read, small_batches

BASE = 1_000_003
WORDS = re.compile(r"\w+")
TILE = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(TILE)]


def windows(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``length`` ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            h = h * np.uint64(BASE) + ids[i : i + n]
    return h


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles of ``shortest`` words or more.

    Longest matches are taken first, ties by the place in the item, then in the document.
    """
    found: list[tuple[int, int, int]] = []
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    # every match starts and ends with a shared window, so only the document's words there count
    length = min(len(item), len(doc))
    while length >= shortest:
        held = _matches(item, doc, free_item, free_doc, length)
        best = 0
        for a, b in held:
            n = _extent(item, doc, free_item, free_doc, a, b)
            best = max(best, n)
        if best > length:  # a longer match exists: search for it first
            length = best
            continue
        for a, b in held:
            if free_item[a : a + length].all() and free_doc[b : b + length].all():
                found.append((a, b, length))
                free_item[a : a + length] = False
                free_doc[b : b + length] = False
        if length == shortest:
            break
        # between the longest match and the minimum, halve while nothing matches
        length = max(shortest, length - 1 if held else length // 2)
    return found


def _matches(item, doc, free_item, free_doc, length):
    a_hash, b_hash = windows(item, length), windows(doc, length)
    if not len(a_hash) or not len(b_hash):
        return []
    open_a = _open(free_item, length)
    a_at = np.flatnonzero(open_a)
    b_at = np.flatnonzero(_open(free_doc, length) & np.isin(b_hash, a_hash[open_a]))
    where: dict[int, list[int]] = {}
    for b in b_at.tolist():
        where.setdefault(int(b_hash[b]), []).append(b)
    pairs = []
    for a in a_at.tolist():
        for b in where.get(int(a_hash[a]), ()):
            if np.array_equal(item[a : a + length], doc[b : b + length]):
                pairs.append((a, b))
    return pairs


def _open(free: np.ndarray, length: int) -> np.ndarray:
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[length:] == taken[:-length]


def _extent(item, doc, free_item, free_doc, a, b) -> int:
    n = 0
    top = min(len(item) - a, len(doc) - b)
    while n < top and item[a + n] == doc[b + n] and free_item[a + n] and free_doc[b + n]:
        n += 1
    return n


class Block:
    """Test items of one block, as ids of their words, with the items of every seed."""

    def __init__(self, items: list[tuple[int, str]], shortest: int):
        self.shortest, self.vocabulary = shortest, {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            words = WORDS.findall((text or "").lower())
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            self.items.append((item, np.array(ids, np.uint64)))
        hashes, owners = [], []
        for k, (_, ids) in enumerate(self.items):
            h = windows(ids, shortest)
            hashes.append(h)
            owners.append(np.full(len(h), k, np.int64))
        seeds = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owners = (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]

    def hits(self, text: str | None, threshold: float):
        """(item_id, coverage, words of the item, tiles) of the items covered to the threshold."""
        look = self.vocabulary.get
        ids = np.array([look(w, 0) for w in WORDS.findall((text or "").lower())], np.uint64)
        h = windows(ids, self.shortest)
        if not len(h) or not len(self.seeds):
            return
        # windows with a word that no item has cannot be seeds
        known = _open(ids > 0, self.shortest)
        at = np.flatnonzero(known)
        left = np.searchsorted(self.seeds, h[at], "left")
        right = np.searchsorted(self.seeds, h[at], "right")
        shared = left < right
        if not shared.any():
            return
        at, left, right = at[shared], left[shared], right[shared]
        joined: dict[int, list[int]] = {}
        for p, lo, hi in zip(at.tolist(), left.tolist(), right.tolist()):
            for k in self.owners[lo:hi].tolist():
                joined.setdefault(k, []).append(p)
        for k, places in sorted(joined.items()):
            item, words = self.items[k]
            # all matches lie in windows with a seed: cut the rest of the document away
            used = np.zeros(len(ids) + 1, np.int64)
            for p in set(places):
                used[p] += 1
                used[p + self.shortest] -= 1
            inside = np.cumsum(used[:-1]) > 0
            near = np.where(inside, ids, np.uint64(0))
            keep = np.flatnonzero(inside | np.concatenate([[False], inside[:-1]]))
            found = tiles(words, near[keep], self.shortest)
            spans = [(a, int(keep[b]), n) for a, b, n in found]
            coverage = sum(n for _, _, n in spans) / len(words)
            if coverage >= threshold:
                yield item, coverage, len(words), spans


def item_blocks(benchmark: DataFrame, shortest: int, block_items: int) -> Iterator[Block]:
    """The test items, ``block_items`` at a time; there is a block even without items."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    part: list[tuple[int, str]] = []
    for row in items.toLocalIterator():
        part.append((row["item_id"], row["text"]))
        if len(part) == block_items:
            yield Block(part, shortest)
            part = []
    yield Block(part, shortest)


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    shortest: int = 5,
    threshold: float = 0.5,
    block_items: int = 20_000,
) -> DataFrame:
    """One row per document and test item whose words are covered to ``threshold`` by tiles of
    ``shortest`` words or more: doc_id, item_id, coverage, item_words, n_tiles, tiles (starts in
    item and document, in words, and length).

    Case and punctuation do not count. The test items come in blocks of ``block_items``, each sent
    whole to every task; the documents are never shuffled. Null and empty texts, items with fewer
    words than a tile and empty tables give no rows; repeated rows give repeated rows. Other columns
    of the inputs are not read.
    """
    schema = (
        "doc_id long, item_id long, coverage double, item_words int, n_tiles int, "
        "tiles array<struct<item_start:int,doc_start:int,length:int>>"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    narrow = documents.select(F.col("doc_id").cast("long"), "text")

    def found(block: Block) -> DataFrame:
        def run(batches):
            for batch in batches:
                rows = [
                    (doc, item, coverage, n, len(spans), [dict(zip(("item_start", "doc_start", "length"), s)) for s in spans])
                    for doc, text in zip(*(c.to_pylist() for c in batch.columns))
                    for item, coverage, n, spans in block.hits(text, threshold)
                ]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=names)

        return narrow.mapInArrow(run, schema)

    return functools.reduce(DataFrame.unionByName, map(found, item_blocks(benchmark, shortest, block_items)))


def is_contaminated(
    text: Column, benchmark: DataFrame, shortest: int = 5, threshold: float = 0.5, block_items: int = 20_000
) -> Column:
    """Whether the text covers a test item as in ``contaminated``. Never null."""

    def flag(block: Block) -> Column:
        @F.pandas_udf("boolean")
        def covered(texts: pd.Series) -> pd.Series:
            return pd.Series([next(block.hits(t, threshold), None) is not None for t in texts], dtype=bool)

        return covered(F.coalesce(text, F.lit("")))

    flags = map(flag, item_blocks(benchmark, shortest, block_items))
    return functools.reduce(lambda a, b: a | b, flags)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
