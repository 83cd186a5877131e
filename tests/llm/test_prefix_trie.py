"""The prefix trie against plain Python."""

import collections
import hashlib
import random
import zlib

import pytest

from stopwise.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    out = []

    def walk(node, parent):
        n = len(members[node])
        leaves, saved = (0, (n - 1) * len(node[-1][1]) if node else 0)
        for kid in kids[node]:
            a, b = walk(kid, min(members[node]))
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, n, len(kids[node]), leaves, saved, digest))
        return leaves, saved

    if turns:
        walk((), None)
    return out


def talks():
    rng = random.Random(4)
    words = ["yes", "no", "", None, "wärum", "x" * 500]
    rows = []
    for c in [*range(0, 60), *range(100, 160), *range(205, 215), 400, 7_000_000_000, 7_000_000_003]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None, ""]), rng.choice(words)))
    rows += [(300, t, "user", f"long {t % 4}") for t in range(30)] + [(320 + c, t, "user", f"long {t % 4}") for c in range(9) for t in range(10 + 2 * c)]
    rows += [(500 + c, t, "system", "same") for c in range(40) for t in range(7)]  # a large group of copies
    rows += [rows[0]] * 3 + [(None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return [(*r, "other") for r in rows]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize(("span", "shard_turns"), [(256, 10**6), (256, 40), (4, 60), (3, 5)])
def test_same_as_plain(spark, span, shard_turns):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = trie.prefix_trie(df, span, shard_turns)
    assert got.columns == trie.RESULT
    assert sorted(map(key, got.collect())) == sorted(map(key, plain(rows)))


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "PARTITION_ROWS", 20)  # long conversations lie in several parts
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(key, trie.prefix_trie(df, 5, 30).collect())) == sorted(map(key, plain(rows)))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", "y")], SCHEMA)
    assert trie.prefix_trie(nobody).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(key, trie.op11_prefix_trie(spark, sf).collect())) == sorted(map(key, plain(rows)))


def test_chunks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 60)
    rows = talks()
    assert sorted(map(key, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 256, 30).collect())) == sorted(map(key, plain(rows)))
