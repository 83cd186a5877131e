"""Operators on documents against plain Python, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stopwise.llm import decontaminate, exact_dedup, mixing, sharding, simhash, suffix_dedup, token_files, toxicity
from stopwise.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int"
SPACES = re.compile(r"[\x20\x09-\x0D]")


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out = list(base)
    out += [base[i % 7] for i in range(40)]
    out += [b.replace(" ", "\n") for b in base[:10]] + [b.replace(" ", "  ") for b in base[:5]]
    out += [base[3] + " " + rng.choice(words) for _ in range(10)]
    out += ["", " ", None, None, "ab", "\t\n", "x" * 700, "x" * 650, "ab " * 400, " ".join(words * 40)]
    return out


def rows():
    out = [(i * 7 % 1000, t, "en", f"s{i % 4}" if i % 9 else None, 1, "k", 2) for i, t in enumerate(texts())]
    return out + [out[5], out[5], (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [random.Random(1).getrandbits(62) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 100):
        got = {r.k: r.v for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("v")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_sharding(docs, none):
    got = sharding.shard_documents(docs).collect()
    want = collections.Counter()
    for r in rows():
        raw = (r[1] or "").encode()
        want[r[0], len(raw) + 1, zlib.crc32(raw), jump(r[0] or 0, 16), jump(r[0] or 0, 17)] += 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).count() == 0


def linked(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)]
    edges += [(500, x) for x in range(400, 600)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = linked(edges, {x for e in edges for x in e})
    assert all(got.get(n, n) == r for n, r in want.items())


@pytest.mark.parametrize("radius", [2, 4])
def test_links_miss_no_pair(spark, radius):
    rng = random.Random(5)
    values = set()
    for base in [rng.getrandbits(64) for _ in range(8)]:
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            values.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
    near = [(a, b) for a, b in itertools.combinations(values, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= radius]
    want = linked(near, values)
    assert all(got.get(v, v) == want[v] for v in values)
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    marks = collections.defaultdict(list)
    for r in rows():
        marks[plain_fingerprint(r[1])].append(r[0])
    near = [(a, b) for a, b in itertools.combinations(marks, 2) if bin(a ^ b).count("1") <= 2]
    roots = linked(near, marks)
    first = {}
    for mark, root in roots.items():
        for i in marks[mark]:
            if i is not None:
                first[root] = min(first.get(root, i), i)
    want = collections.Counter((i, f"{m:016x}", first.get(roots[m])) for m, ids in marks.items() for i in ids)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_exact_dedup(docs, none):
    for limit in (1 << 24, 1):  # a filter that holds everything takes the other way
        got = exact_dedup.exact_dedup(docs.withColumn("kept", F.lit(5)), limit_bytes=limit).collect()
        groups = collections.defaultdict(list)
        for r in rows():
            groups[SPACES.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
        want = collections.Counter()
        for text, members in groups.items():
            members.sort()
            for k, m in enumerate(members):
                want[m[3], members[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len([w for w in SPACES.split(t or "") if w])
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert abs(sum({s: v[0].target for s, v in by.items()}.values()) - total) < 1e-6 * total
    for members in by.values():
        assert members[0].target <= 3 * members[0].source_size + 1e-6
        assert abs(sum(r.taken for r in members) - members[0].target) <= 12
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixing.mixed_documents(none).count() == 0


def test_source_limits(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1), ("c", 100), (None, 2), ("e", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sources, (1, 2, 3)).collect()}
    # by hand: b stops at 3, null at 6, e at 0; a and c share the rest 1 : 3, where a gets 26
    assert got["b"] == 3 and got[None] == 6 and got["e"] == 0
    assert got["a"] == pytest.approx(26) and got["c"] == pytest.approx(78)


def test_token_files(spark, docs, none, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    odd = ["a\tb", "x <|endoftext|> Y.", "<|ENDOFTEXT|>", "ΣΑΣ Σ.", "é ́x", "don't I'LL 12a3", "foo).,", "日本", "m²,", "İ.",
           "RAESUE%%%", "Boats'", "x's!!'", "a_b_", "é&&&'", "'", "7''s", "don't'!", "ß`", "x''re."]
    encoder = token_files.Encoder(path, words=50)
    for text in odd + [t for t in texts() if t]:
        assert encoder.encode(text, 1).tolist() == whole.encode(text, add_special_tokens=False).ids + [1]
    folder = f"file://{tmp_path}/ids"
    files = token_files.write_token_files(docs, path, folder, frame_bytes=300)
    got = token_files.read_token_files(files, folder).collect()
    at, want = 0, collections.Counter()
    order = sorted(got, key=lambda r: r.start)
    sizes = {r.start: r.n_tokens for r in got}
    assert [r.doc_id for r in order] == sorted([r[0] for r in rows()], key=lambda i: -1 if i is None else i)
    for r in order:
        assert r.start == at
        at += sizes[r.start]
    for r in rows():
        ids = np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    empty = token_files.write_token_files(none, path, folder)
    assert token_files.read_token_files(empty, folder).count() == 0
    # a damaged frame is found
    fs, root = token_files.open_fs(folder)
    name = files.orderBy(F.desc("ids")).first().path
    raw = bytearray(open(name, "rb").read())
    raw[12] ^= 0xFF
    open(name, "wb").write(raw)
    with fs.open_input_file(name) as source, pytest.raises(Exception):
        token_files.Reader(source).frame(0)


def plain_removal(all_texts, length):
    seen = collections.Counter(t[i : i + length] for t in all_texts for i in range(len(t) - length + 1))
    out = []
    for t in all_texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        parts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), parts, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_suffix_dedup(docs, none, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", most)  # a small bound sends grams across buckets
    got = suffix_dedup.remove_repeats(docs).drop("kept").collect()
    ids = [r[0] for r in rows()]
    want = plain_removal([(r[1] or "").encode() for r in rows()], 200)
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, *w) for i, w in zip(ids, want))
    if most > 2:
        assert suffix_dedup.remove_repeats(none).count() == 0


def test_long_texts_come_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 101, 5000, np.uint8).tobytes()
    whole = [r[:4] for r in [next(suffix_dedup.chunks([raw], 200))]][0]
    a = suffix_dedup.runs(whole[0], whole[1], 200)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    covered = []
    for buffer, text, starts, offsets, _ in suffix_dedup.chunks([raw], 200):
        first, last, *_ = suffix_dedup.runs(buffer, text, 200)
        shift = offsets[text[first]] - starts[text[first]] if len(first) else 0
        for x, y in zip((first + shift).tolist(), (last + shift).tolist()):
            covered += range(x, y + 1)
    assert sorted(covered) == [p for x, y in zip(a[0], a[1]) for p in range(x, y + 1)] == list(range(4801))


def plain_tiles(item, doc, shortest):
    free_a, free_b, out = [True] * len(item), [True] * len(doc), 0
    while True:
        best, found = shortest - 1, []
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while (
                    a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_a[a + n] and free_b[b + n]
                ):
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best and n >= shortest:
                    found.append((a, b))
        if best < shortest:
            return out
        for a, b in found:
            if all(free_a[a : a + best]) and all(free_b[b : b + best]):
                out += best
                free_a[a : a + best] = [False] * best
                free_b[b : b + best] = [False] * best


def test_tiles():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.randint(1, 6) for _ in range(rng.randint(5, 30))]
        doc = [rng.randint(1, 6) for _ in range(30)]
        for _ in range(3):
            a = rng.randrange(len(item))
            doc[rng.randrange(30) :][:0] = item[a : a + rng.randint(3, 12)]
        found = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert sum(n for *_, n in found) == plain_tiles(item, doc, 3)
        for a, b, n in found:
            assert item[a : a + n] == doc[b : b + n]


def test_decontamination(spark, none):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew strange green tea"
    w = item.split()
    cases = {
        1: f"intro words {item} outro",
        2: " ".join(["Noise", *w[8:], "noise", *w[:8]]).upper(),  # other order and case
        3: " ".join(w[:5]) + " and nothing else of it",
        4: "clean text without any of it",
        5: None,
        6: "",
    }
    docs = spark.createDataFrame(list(cases.items()) + [(1, cases[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "too short"), (6, "")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 9), (1, 9), (2, 9)]
    assert all(r.coverage == 1.0 for r in got)
    assert {r.doc_id: r.n_tiles for r in got} == {1: 1, 2: 2}
    for r in got:
        words = decontaminate.WORDS.findall(cases[r.doc_id].lower())
        for t in r.tiles:
            assert w[t.item_start : t.item_start + t.length] == words[t.doc_start : t.doc_start + t.length]
    one = decontaminate.contaminated(docs, bench, block_items=1).collect()
    assert sorted(map(str, one)) == sorted(map(str, got))
    flagged = docs.where(decontaminate.is_contaminated(F.col("text"), bench)).collect()
    assert sorted(r.doc_id for r in flagged) == [1, 1, 2]
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_gradients():
    net = toxicity.Network()
    words = toxicity.Words([b"you clown, what is this", b"hello there", b"", b"x " * 150])
    ids, sizes, owners = words.windows()
    assert owners.tolist() == [0, 1, 2, 3, 3, 3]
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    labels = np.array([1.0, 0, 1, 0, 1, 0])

    def loss():
        s = net.forward(net.inputs(words), ids, sizes)
        return (np.log1p(np.exp(-s)) * labels + np.log1p(np.exp(s)) * (1 - labels)).sum()

    x = net.inputs(words)
    logits, kept = net.forward(x, ids, sizes, keep=True)
    grads = net.gradients(words, x, ids, sizes, 1 / (1 + np.exp(-logits)) - labels, kept)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)


def test_toxicity(spark, none):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abdefgh") for _ in range(5)) for _ in range(80)]
    data, marks = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 150))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["Idiot!", "scum", "moron,"])
        data.append((i, " ".join(words), 1))
        marks.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(data + [(5000, None, 1), (5001, "", 1), (5002, "!!! 123", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(marks + [(None, 1), (7777, 1)], "doc_id long, toxic int")
    net = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, net).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got.values())
    assert got[5000].score == got[5001].score == got[5002].score
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == int(i % 3 == 0) for i in held)
    assert right >= 0.95 * len(held)
    ids = {r.doc_id for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).where("h").collect()}
    assert ids & set(range(900)) == set(held)
    # a toxic word far behind counts like one in front
    long_text = " ".join(plain[:20] * 400) + " idiot scum"
    far = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    assert toxicity.score_toxicity(far, net).first().predicted == 1
    assert toxicity.score_toxicity(none, net).count() == 0
    assert toxicity.fit_toxicity(docs, labels.limit(0)) is None
    assert {r.predicted for r in toxicity.score_toxicity(docs, None).collect()} == {0}
