"""Near copies by the Jaccard similarity of their word shingles, found without loss.

Texts with equal sets of shingles are one node. All shingles are put in one order, the rare ones
first; two sets whose similarity reaches the limit then share a shingle among the first of both
(prefix filtering), so the nodes that meet at such a shingle are all candidates. They are met twice.
First every node of a shingle meets only the node with the most company, which settles large groups
without pairing them up. Then nodes meet each other, but only where what was found so far leaves
different groups at one shingle. Every link is confirmed by the sets themselves.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stopwise.llm.components import components
from stopwise.workspace import staged

SEED = 42
WORDS = 5  # of a shingle
# Cells of the table of shingle frequencies, the only data that reaches the driver.
CELLS = 1 << 18
# Sets a and b are near copies if 5 * shared >= 4 * united, in whole numbers.
LIMIT = (4, 5)


def shingle_set(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle."""
    tokens = (raw or b"").lower().split()  # both take ASCII letters and ASCII white space only
    if not tokens:
        return np.zeros(0, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) < words:
        hashes = {digest(join(tokens), SEED)}
    else:
        hashes = {digest(join(s), SEED) for s in zip(*[tokens[i:] for i in range(words)])}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(b"")))


def with_nodes(docs: DataFrame) -> DataFrame:
    """(id, hash, node, cells, counts) of (id, text): ``node`` is a 64-bit hash of the whole set. Rows
    with cells in place of a node tell in how many of a task's sets shingles of these cells are."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate([*sets, np.zeros(0, np.int64)])
            total += np.bincount(flat & (CELLS - 1), minlength=CELLS)
            none = pa.nulls(len(sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes), none, none], names=names)
        cells = np.flatnonzero(total)
        one = [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (cells, total[cells])]
        yield pa.RecordBatch.from_arrays([*one, *lists], names=names)

    names = ["id", "hash", "node", "cells", "counts"]
    narrow = docs.select("id", text_hash(F.col("text")).alias("hash"), "text")
    kind = to_arrow_type(narrow.schema["id"].dataType)
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, hash long, node long, cells array<long>, counts array<long>"
    return narrow.mapInArrow(run, schema)


def frequencies(nodes: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of every cell; only the order of shingles depends on it."""
    both = F.explode(F.arrays_zip("cells", "counts")).alias("c")
    counted = nodes.where("cells IS NOT NULL").select(both).groupBy("c.cells").agg(F.sum("c.counts").alias("n"))
    out = np.zeros(CELLS, np.int64)
    found = counted.toArrow()
    out[found["cells"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """(shingle, node, size, at): the first shingles of every set, of which two near copies share one.
    Equal sets have equal rows, which a task gives once."""
    above, below = limit

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, firsts, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                node = xxhash.xxh64_intdigest(s.tobytes(), SEED)
                n = len(s)
                if n == 0 or node in seen:
                    continue
                seen.add(node)
                # a near copy shares at least ceil(limit * n) of the n shingles
                keep = n + (-above * n) // below + 1
                firsts.append(s[np.lexsort((s, counts[s & (CELLS - 1)]))[:keep]])
                nodes.append(node)
                sizes.append(n)
            lengths = np.array([len(x) for x in firsts], np.int64)
            flat = np.concatenate([*firsts, np.zeros(0, np.int64)])
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [flat, np.repeat(np.array(nodes, np.uint64).view(np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "size", "at"])

    return docs.select("text").mapInArrow(run, "shingle long, node long, size int, at int")


def met_rows(batches):
    """Of rows sorted by shingle and node, each node once, and only shingles of two nodes or more. No
    group is held: a row needs to know the rows beside it only."""
    names = ["shingle", "node", "size", "at"]
    last: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
    met = None  # the shingle of the row before the last
    for batch in batches:
        rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(last, batch.columns)]
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [c[new] for c in rows]
        if not len(rows[0]):
            continue
        same = np.concatenate([[rows[0][0] == met], rows[0][1:] == rows[0][:-1]])
        kept = same[:-1] | same[1:]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][kept]) for c in rows], names=names)
        if len(rows[0]) > 1:
            met = rows[0][-2]
        last = [c[-1:] for c in rows]
    kept = np.array([met is not None and x == met for x in last[0]], bool)
    yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in last], names=names)


def sets_of(nodes: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the shingles of the wanted nodes, from the text of one document of each."""
    first = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("hash", "id")).alias("f"))
    first = staged(first.select("node", F.col("f.hash").alias("_hash"), F.col("f.id").alias("_id")), "candidate-nodes")
    same = (text_hash(F.col("text")) == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
    texts = docs.join(first, same).select("node", "text")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    # rows of one id and text may be repeated
    return texts.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """Those of the pairs (a, b) whose sets are near copies."""
    above, below = limit
    pairs = staged(pairs, "candidates")
    held = staged(sets_of(nodes, docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "candidate-sets")
    left = held.select(F.col("node").alias("a"), F.col("s").alias("_s"))
    right = held.select(F.col("node").alias("b"), F.col("s").alias("_t"))
    shared = F.size(F.array_intersect("_s", "_t"))
    united = F.size("_s") + F.size("_t") - shared
    return pairs.join(left, "a").join(right, "b").where(shared * below >= united * above).select("a", "b")


def links(nodes: DataFrame, docs: DataFrame, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """(a, b): links between nodes whose components are those of all near copies. ``nodes`` must be a
    written table."""
    above, below = limit
    first = prefixes(docs, frequencies(nodes), limit).repartition("shingle").sortWithinPartitions("shingle", "node")
    # most shingles are met once and are gone before anything is written
    first = staged(first.mapInArrow(met_rows, "shingle long, node long, size int, at int"), "met")
    nodes = nodes.where("cells IS NULL").select("id", "hash", "node")
    counts = first.groupBy("shingle").agg(F.count("*").alias("n"))
    met = first.join(counts, "shingle")

    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    company = staged(company, "company")
    best = staged(first.join(company, "node").groupBy("shingle").agg(F.max(F.struct("company", "node", "size")).alias("best")), "best")
    alike = F.least("size", "best.size") * below >= F.greatest("size", "best.size") * above
    stars = first.join(best, "shingle").where(alike & (F.col("node") != F.col("best.node")))
    stars = stars.select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b")).distinct()
    found = staged(confirmed(stars, nodes, docs, limit), "star-links")

    roots = components(found).withColumnRenamed("node", "_node")
    grouped = first.join(staged(roots, "roots"), F.col("node") == F.col("_node"), "left")
    grouped = grouped.select("shingle", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    open_ = grouped.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rest = staged(grouped.join(open_.select("shingle"), "shingle"), "open-shingles")
    other = rest.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("node", "size", "at", "root")])
    sizes = F.col("size") + F.col("_size")
    # what both sets can still share from this shingle on
    most = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
    alike = F.least("size", "_size") * below >= F.greatest("size", "_size") * above
    # no pair is lost here: at the first shingle that two near copies share, nothing shared lies before it
    alike = alike & (most * (above + below) >= sizes * above)
    pairs = rest.join(other, "shingle").where((F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & alike)
    pairs = pairs.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()
    return found.unionByName(confirmed(pairs, nodes, docs, limit))


def near_copies(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: tuple[int, int] = LIMIT
) -> DataFrame:
    """(id, component_id) for every document: the smallest id among all that are linked to it.

    A null text counts as empty; texts without words are copies of each other; repeated rows stay
    repeated; null ids never name a component unless all its ids are null; an empty table gives an
    empty result.
    """
    # read as often as sets are wanted: texts are not written again, nor are their shingles
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    sets = staged(with_nodes(docs), "shingle-nodes")
    nodes = components(links(sets, docs, limit)).withColumnRenamed("node", "_node")
    sets = sets.where("cells IS NULL").select("id", "node")
    kinds = sets.groupBy("node").agg(F.min("id").alias("first"))
    rooted = kinds.join(nodes, F.col("node") == F.col("_node"), "left")
    rooted = staged(rooted.select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = staged(rooted.join(named, "root").select(F.col("node").alias("_node"), "component_id"), "copy-names")
    return sets.join(names, F.col("node") == F.col("_node")).select(F.col("id").alias(id_column), "component_id")
