"""Prefix trie of conversations by range partitions and a skeleton of their splitter paths.

A conversation is the path of its turns, 16 bytes of digest a turn, so that byte order is the order
of the trie. Splitters from a bounded sample cut the sorted paths into shards. A node on the path of
a splitter is a skeleton node and may have members in several shards; any other node lies within one.
Every task gets the splitters, reads its sorted shard once with a stack of open nodes, finishes the
nodes within it, and gives a partial aggregate for each skeleton node; these are added up by Spark.

Paths are cut every SPAN turns. A piece starts where its conversation's piece before ended, named by
a digest of all turns so far, and is a path in a tree of its own; what a deeper tree adds to the
nodes above it comes from a first pass over the deeper pieces alone.
"""

import bisect
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopwise.llm.tables import read
from stopwise.workspace import staged

KEY = 16  # bytes of a turn's digest
SPAN = 256  # turns of a piece
SHARD_TURNS = 50_000
MOST_SHARDS = 2048  # bounds the splitters; shards beyond it grow, which a task reads as a stream
SAMPLES = 16  # for every shard
CHUNK = 1 << 16  # bytes of ids sent on at once
PARTITION_ROWS = 100_000

NODE = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string, id binary, parent binary, above array<binary>, last long,"
    " deep_children long, deep_leaves long, deep_saved long, shard int, seq long, ids binary"
)
NAMES = [f.split()[0] for f in NODE.split(", ")]
FINAL, WAITING, PARTIAL, IDS = range(4)
RESULT = NAMES[1:9]


def digest(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts)).digest()


# ---- conversations as paths ----


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, key, size) of every turn, and its number ``at`` among the turns of its
    conversation in this part, from 1. Parts are ranges of (conversation, turn), so that a long
    conversation is dealt over many."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        "turn",
        # the role's length keeps both parts apart
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.length(text).cast("long").alias("size"),
    )
    turns = staged(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    parts = max(1, -(-turns.count() // PARTITION_ROWS))

    def run(batches):
        part, conv, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for c in batch.column(0).to_pylist():
                at = at + 1 if c == conv else 1
                conv = c
                numbers.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), batch.column(2), batch.column(3)],
                names=["conv_id", "part", "at", "key", "size"],
            )

    ordered = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "conv_id long, part int, at long, key binary, size long"
    return staged(ordered.mapInArrow(run, schema), "numbered-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, key, size) of the rebuilt conversations, and (conv_id, length) of all."""
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    spans = staged(turns.groupBy("conv_id", "part").agg(F.max("at").alias("n")), "turn-spans")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lengths = spans.groupBy("conv_id").agg(F.sum("n").alias("own"))
    first = lengths.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.least("own", F.lit(5)).alias("there"))
    convs = lengths.withColumn("base", base).join(first, "base", "left")
    convs = convs.withColumn("held", held).withColumn("head", F.least("held", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("held"), F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "held", "head", "length"), "conversations")
    spans = spans.select("conv_id", "part", "offset").join(convs.select("conv_id", "held", "head"), "conv_id")
    # one row for every conversation and part: a long conversation's turns meet many of them
    placed = turns.join(staged(spans, "turn-offsets"), ["conv_id", "part"]).withColumn("pos", F.col("offset") + F.col("at"))
    own = placed.where("pos > held").select("conv_id", (F.col("head") + F.col("pos") - F.col("held")).alias("depth"), "key", "size")
    heads = placed.where("conv_id % 100 = 0 AND pos <= 5").select(F.col("conv_id").alias("base"), "pos", "key", "size")
    # a base has 100 conversations and 5 turns at most
    shared = convs.join(staged(heads, "heads"), "base").where("pos <= head")
    shared = shared.select("conv_id", F.col("pos").alias("depth"), "key", "size")
    return own.unionByName(shared), convs.select("conv_id", "length")


def pieces(turns: DataFrame, convs: DataFrame, span: int) -> DataFrame:
    """(conv, piece, start, path, sizes, more, end) of every conversation cut every ``span`` turns.
    ``start`` is empty for first pieces; ``end``, where a whole piece ends, is what the next starts with."""
    at = F.col("depth") - 1
    grouped = turns.groupBy(F.col("conv_id").alias("conv"), F.floor(at / span).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "key", "size"))).alias("t")  # at most ``span``
    )
    grouped = grouped.select(
        "conv", "piece", F.unhex(F.array_join(F.transform("t.key", F.hex), "")).alias("path"), F.col("t.size").alias("sizes")
    )
    bare = convs.where("length = 0").select(
        F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("piece"), F.lit(b"").alias("path"), F.array().cast("array<long>").alias("sizes")
    )
    grouped = staged(grouped.unionByName(bare), "pieces")
    long_ = convs.where(F.col("length") >= span).select(F.col("conv_id").alias("conv"), "length")
    marks = grouped.join(long_, "conv").where(F.size("sizes") == span)
    marks = marks.groupBy("conv", "length").agg(F.sort_array(F.collect_list(F.struct("piece", F.unhex(F.md5("path")).alias("m")))).alias("m"))

    def chain(batches):
        for batch in batches:
            out = []
            for conv, length, found in zip(*(c.to_pylist() for c in batch.columns)):
                start = b""
                for m in found:
                    end = digest(start, m["m"])
                    out.append((conv, m["piece"], start, end, length > (m["piece"] + 1) * span))
                    start = end
                if length % span:
                    out.append((conv, length // span, start, None, False))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["conv", "piece", "start", "end", "more"]
            )

    ends = marks.select("conv", "length", "m").mapInArrow(chain, "conv long, piece long, start binary, end binary, more boolean")
    joined = grouped.join(staged(ends, "piece-ends"), ["conv", "piece"], "left")
    return joined.select(
        "conv", "piece", F.coalesce("start", F.lit(b"")).alias("start"), "path", "sizes", F.coalesce("more", F.lit(False)).alias("more"), "end"
    )


# ---- the trie ----


class Node:
    """An open node; ``ahead``: it is on the path of a splitter."""

    __slots__ = ("ahead", "children", "deep", "hash", "ids", "k", "last", "least", "leaves", "n", "pending", "saved", "seq")

    def __init__(self, k: int, last: int, ahead: bool):
        self.k, self.last, self.ahead = k, last, ahead
        self.n, self.least = 0, None
        self.children = self.leaves = self.saved = 0
        self.deep = (0, 0, 0)
        self.hash, self.ids, self.seq = hashlib.sha256(), [], 0
        self.pending: list[list] = []


class Shards:
    """Splitters of sorted pieces: tuples (start, path, conversation). Ids go out in chunks of ``chunk`` bytes."""

    def __init__(self, splitters: list[tuple[bytes, bytes, int]], chunk: int):
        self.splitters, self.chunk = splitters, chunk

    def shard(self, key: tuple[bytes, bytes, int]) -> int:
        return bisect.bisect_right(self.splitters, key)

    def skeleton_depth(self, key: tuple[bytes, bytes, int]) -> int:
        """Turns of a path that it shares with a splitter's; -1 if no splitter has its start. The
        splitters next to it in the order share the most."""
        k, most = self.shard(key), -1
        for start, path, _ in self.splitters[max(0, k - 1) : k + 1]:
            if start == key[0]:
                most = max(most, shared_turns(path, key[1]))
        return most


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    low, high = 0, n  # the first ``low`` turns are shared
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * KEY : middle * KEY] == b[low * KEY : middle * KEY]:
            low = middle
        else:
            high = middle
    return low


def splitters_of(rows: DataFrame, shards: int) -> list[tuple[bytes, bytes, int]]:
    """Cuts of the sorted pieces into parts of about equal turns, each with as few turns as tell the
    samples on both sides apart. The sample is bounded by ``shards``."""
    if shards == 1:
        return []
    count = rows.count()
    share = min(1.0, SAMPLES * shards / max(count, 1))
    picked = F.pmod(F.xxhash64("conv", "piece"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = sorted((r["start"], r["path"], r["conv"]) for r in map(_bytes, rows.where(picked).select("start", "path", "conv").collect()))
    cuts, weight, total = [], 0, sum(len(p) // KEY + 1 for _, p, _ in sample)
    for one, two in zip(sample, sample[1:]):
        weight += len(one[1]) // KEY + 1
        if weight * shards < total * (len(cuts) + 1):
            continue
        if one[0] != two[0]:
            cuts.append((two[0], b"", -(1 << 63)))
        elif one[1] != two[1]:
            cuts.append((two[0], two[1][: (shared_turns(one[1], two[1]) + 1) * KEY], -(1 << 63)))
        else:
            cuts.append(two)
    return cuts


def _bytes(row) -> dict:
    return {k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.asDict().items()}


def trie_rows(batches, shards: Shards, span: int):
    """Nodes of sorted pieces (shard, start, path, conv, piece, sizes, more, top, deep_children,
    deep_leaves, deep_saved), as rows of NODE. A node goes out when the first piece beyond it comes."""
    out: list[list] = []
    stack: list[Node] = []
    now = (None, b"", b"", 0, 0)  # shard, start, path, piece and top of the last row
    depth = -1  # turns of its path that are skeleton nodes

    def identity(k: int) -> bytes:
        return digest(now[1], b"/", now[2][: k * KEY])

    def send_ids(node: Node):
        row = dict(kind=IDS, id=identity(node.k), shard=now[0], seq=node.seq, ids=",".join(node.ids).encode())
        out.append([row.get(c) for c in NAMES])
        node.ids, node.seq = [], node.seq + 1

    def add_end(node: Node, conv: int):
        if node.ahead:
            node.ids.append(str(conv))
            if len(node.ids) * 20 >= shards.chunk:
                send_ids(node)
        else:
            node.hash.update((b"," if node.seq else b"") + str(conv).encode())
            node.seq += 1

    def close():
        node = stack.pop()
        k, skeleton = node.k, node.ahead
        deep_children, deep_leaves, deep_saved = node.deep
        row = dict(conv_id=node.least, depth=now[3] * span + k, n_convs=node.n, last=node.last)
        if skeleton:
            if node.ids:
                send_ids(node)
            row.update(kind=PARTIAL, parent_conv_id=now[4] if k == 1 else None, n_children=node.children, n_leaves=node.leaves)
            row.update(saved_tokens=node.saved, id=identity(k), parent=identity(k - 1) if k else None, above=[identity(j) for j in range(k + 1)])
            row.update(deep_children=deep_children, deep_leaves=deep_leaves, deep_saved=deep_saved)
        else:
            children = node.children + deep_children
            leaves = node.leaves + deep_leaves if children else 1
            saved = (node.n - 1) * node.last + node.saved + deep_saved
            row.update(n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=node.hash.hexdigest())
            row.update(kind=FINAL, id=identity(0) if k == 0 else None)
            for child in node.pending:
                child[3] = node.least
                out.append(child)
        if k:
            parent = stack[-1]
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            if not skeleton:
                parent.children += 1
                parent.leaves += row["n_leaves"]
                parent.saved += row["saved_tokens"]
                if k == 1:
                    row["parent_conv_id"] = now[4]
                elif parent.ahead:
                    row.update(kind=WAITING, parent=identity(k - 1))
                else:
                    parent.pending.append([row.get(c) for c in NAMES])
                    return
        out.append([row.get(c) for c in NAMES])

    def flush():
        columns = list(zip(*out)) or [()] * len(NAMES)
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
        arrays = [pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, NODE.split(", "))]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names=NAMES)

    for batch in batches:
        for shard, start, path, conv, piece, sizes, more, top, *deep in zip(*(c.to_pylist() for c in batch.columns)):
            same = (shard, start) == now[:2]
            common = shared_turns(path, now[2]) if same else -1
            while stack and stack[-1].k > common:
                close()
            if not same or path != now[2]:
                now = (shard, start, path, piece, top)
                depth = shards.skeleton_depth((start, path, conv))
            for k in range(common + 1, len(sizes) + 1):
                stack.append(Node(k, sizes[k - 1] if k else 0, k <= depth))
            leaf = stack[-1]
            leaf.n += 1
            leaf.least = conv if leaf.least is None else min(leaf.least, conv)
            if more:
                leaf.deep = tuple(deep)
            else:
                add_end(leaf, conv)
            if len(out) >= 5000:
                yield flush()
    while stack:
        close()
    yield flush()


def sha_of_ids(batches):
    """(id, ends_sha256) of skeleton nodes from their chunks of ids (id, shard, seq, ids), in order."""
    last, state, out = None, None, []
    for batch in batches:
        for node, _, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != last:
                if last is not None:
                    out.append((last, state.hexdigest()))
                last, state = node, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if last is not None:
        out.append((last, state.hexdigest()))
    columns = list(zip(*out)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["id", "ends_sha256"])


def forest(rows: DataFrame, span: int, shard_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of all trees (RESULT columns), and the trees' tops (id, n_children, n_leaves, saved_tokens)."""
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = Shards(splitters_of(rows, max(1, min(MOST_SHARDS, -(-turns // shard_turns)))), CHUNK)
    order = ["shard", "start", "path", "conv"]
    columns = [*order[1:], "piece", "sizes", "more", "top", "deep_children", "deep_leaves", "deep_saved"]

    def deal(batches):
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            found = pa.array([shards.shard(k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([found, *batch.columns], names=["shard", *columns])

    kinds = (
        "shard int, start binary, path binary, conv long, piece long, sizes array<long>, more boolean, top long,"
        " deep_children long, deep_leaves long, deep_saved long"
    )
    count = len(shards.splitters) + 1
    dealt = rows.select(*columns).mapInArrow(deal, kinds).repartition(count, "shard").sortWithinPartitions(*order)
    nodes = staged(dealt.mapInArrow(lambda batches: trie_rows(batches, shards, span), NODE), "trie-nodes")

    chunks = nodes.where(F.col("kind") == IDS).select("id", "shard", "seq", "ids")
    hashes = chunks.repartition("id").sortWithinPartitions("id", "shard", "seq").mapInArrow(sha_of_ids, "id binary, ends_sha256 string")
    partial = nodes.where(F.col("kind") == PARTIAL)
    skeleton = partial.groupBy("id").agg(
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "parent", "last", "above")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("deep_children", "deep_leaves", "deep_saved")],
    )
    # as many rows as turns on the splitters' paths
    skeleton = staged(skeleton, "skeleton")
    below = skeleton.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("near"))
    own = skeleton.join(below, "id", "left").withColumn(
        "n_children", F.col("n_children") + F.col("deep_children") + F.coalesce("near", F.lit(0))
    )
    own = own.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves") + F.col("deep_leaves")))
    saved = (F.col("n_convs") - 1) * F.col("last") + F.col("saved_tokens") + F.col("deep_saved")
    own = staged(own.withColumn("saved_tokens", saved).drop("near"), "skeleton-own")
    up = own.select(F.explode("above").alias("id"), "n_leaves", "saved_tokens").groupBy("id")
    up = up.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = own.select(F.col("id").alias("parent"), F.col("conv_id").alias("_parent"))
    bare = hashlib.sha256(b"").hexdigest()
    whole = own.drop("n_leaves", "saved_tokens").join(up, "id").join(hashes, "id", "left").join(parents, "parent", "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(bare)))
    whole = staged(whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select("id", *RESULT), "skeleton-nodes")

    final = nodes.where(F.col("kind") == FINAL)
    waiting = nodes.where(F.col("kind") == WAITING).join(parents, "parent", "left")
    waiting = waiting.withColumn("parent_conv_id", F.col("_parent"))
    every = final.select(*RESULT).unionByName(waiting.select(*RESULT)).unionByName(whole.select(*RESULT))
    tops = final.where("id IS NOT NULL").select("id", *RESULT).unionByName(whole.where(F.col("depth") % span == 0))
    return every, tops


def prefix_trie(conversations: DataFrame, span: int = SPAN, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for every node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every conversation takes the first h turns of conversation c - c % 100 in place of its own, with
    h = crc32(decimal c) % 6. Turns go by ``turn``, null first, and at one turn by a digest of role
    and text; repeated rows are turns of their own. Null role or text counts as empty. Rows without a
    conv_id belong to no conversation and are left out. Without conversations there is no root and
    the result is empty. Columns other than conv_id, turn, role and text are not read.
    """
    turns, convs = rebuilt(numbered(conversations.select("conv_id", "turn", "role", "text")))
    rows = staged(pieces(turns, convs, span), "paths")
    first = rows.agg(F.min("conv").alias("conv")).first()["conv"]
    # where a whole piece ends: the node's smallest member, also of those that go no further
    ends = staged(rows.where("end IS NOT NULL").groupBy("end").agg(F.min("conv").alias("top")), "ends")
    none = F.lit(0).cast("long")
    rows = rows.join(ends.withColumnRenamed("end", "start"), "start", "left").withColumn("top", F.coalesce("top", F.lit(first).cast("long")))
    rows = staged(rows, "topped-paths")
    # one child stands for what comes below, so that a place in a conversation is no leaf
    flat = [F.when(F.col("more"), 1).otherwise(0).cast("long").alias("deep_children"), none.alias("deep_leaves"), none.alias("deep_saved")]
    later = rows.where("piece > 0")
    if later.isEmpty():
        return forest(rows.select("*", *flat), span, shard_turns)[0]

    _, tops = forest(later.select("*", *flat), span, shard_turns)

    starts = later.groupBy("start").agg(F.min("conv").alias("owner"))
    starts = starts.withColumn("id", F.unhex(F.md5(F.concat("start", F.lit(b"/")))))
    local = starts.join(tops.select("id", "n_children", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), "id")
    local = staged(local.select("start", "owner", "n_children", "leaves", "saved"), "later-trees")
    # a tree's owner counts it once for all its members; what lies below a place is the rest of its members' sums
    owned = later.join(local, "start").select("conv", "piece", "start", "n_children", "owner", "leaves", "saved")
    mine = F.col("owner") == F.col("conv")
    rest = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, 0)
    sums = owned.select(
        "start",
        "n_children",
        F.sum(F.when(mine, F.col("leaves")).otherwise(0)).over(rest).alias("leaves"),
        F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(rest).alias("saved"),
    )
    deep = sums.groupBy(F.col("start").alias("end")).agg(
        F.first("n_children").alias("deep_children"), F.sum("leaves").alias("deep_leaves"), F.sum("saved").alias("deep_saved")
    )
    rows = rows.join(staged(deep, "below"), "end", "left").fillna(0, ["deep_children", "deep_leaves", "deep_saved"])
    nodes = forest(rows, span, shard_turns)[0]
    # a later tree's own top is the end of the piece above it
    return nodes.where("depth = 0 OR parent_conv_id IS NOT NULL")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH k AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (
  SELECT conv_id, key, length(text) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos
  FROM k),
b AS (  -- the bits of the decimal id, each byte from its lowest bit on
  SELECT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda x: list_transform(range(8), lambda i: (ord(x) >> i) & 1))) AS bits
  FROM (SELECT DISTINCT conv_id FROM k)),
c AS MATERIALIZED (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, bits),
           lambda a, x: xor(a >> 1, CASE WHEN (xor(a, x) & 1) = 1 THEN 3988292384 ELSE 0 END))) % 6 AS h
  FROM b),
r AS (
  SELECT c.conv_id, pos, key, size, 0 AS later FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL SELECT c.conv_id, pos, key, size, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
m AS MATERIALIZED (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY later, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS MATERIALIZED (SELECT conv_id, max(depth) AS length FROM m GROUP BY conv_id),
n AS MATERIALIZED (
  SELECT path, depth, any_value(size) AS size, min(m.conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (depth = length), '')) AS ends
  FROM m JOIN e ON m.conv_id = e.conv_id GROUP BY path, depth),
f AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM n q WHERE q.depth = n.depth + 1 AND starts_with(q.path, n.path)) AS n_children
  FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = left(n.path, greatest(length(n.path) - 32, 0)))
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children,
       CAST(sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum((u.n_convs - 1) * u.size) AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM f v JOIN f u ON starts_with(u.path, v.path)
GROUP BY v.path, v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, v.ends
"""
