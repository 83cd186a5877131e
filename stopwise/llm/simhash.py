"""SimHash near-duplicates found by covering locality-sensitive hashing (Pagh).

Every bit position of the fingerprint gets a vector of radius + 1 bits; table v keeps the positions
whose vector has an odd product with v. For any ``radius`` positions some v is orthogonal to all of
their vectors, so two fingerprints that differ there agree in table v: no pair is missed.

Fingerprints that meet in a bucket are linked without pairing them up: each one sends itself and
its neighbours by radius / 2 flips of bits that vary within its buckets. Two fingerprints within
the radius have a common neighbour half-way, and two with a common neighbour are within the radius.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.components import components
from stopwise.llm.tables import read, small_batches
from stopwise.workspace import staged

SEED = 42
CHUNK = 1 << 16


def fingerprint(raw: bytes | None, words: int = 3) -> bytes:
    """64 bits, big-endian: those set in over half of the hashes of the text's word shingles."""
    tokens = (raw or b"").lower().split()  # both take ASCII letters and ASCII white space only
    if not tokens:
        return bytes(8)
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, CHUNK):
        part = tokens[at : at + CHUNK + words - 1]
        if len(part) < words:
            hashes = digest(join(part), SEED)
        else:
            shingles = zip(*[part[i:] for i in range(words)])
            hashes = b"".join([digest(join(s), SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.uint32)
    return np.packbits(ones * 2 > n).tobytes()


def with_fingerprints(documents: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            marks = b"".join([fingerprint(t, words) for t in batch.column(1).to_pylist()])
            fps = pa.array(np.frombuffer(marks, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    narrow = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks of the tables, as signed 64-bit integers."""
    count = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, count + 1):
        mask = sum(1 << i for i in range(64) if bin((i % count + 1) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def neighbours(fp: Column, flips: Column, radius: int) -> Column:
    """The fingerprint and what radius / 2 or fewer flips of the bits in ``flips`` make of it."""
    ones = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    bits = F.filter(ones, lambda b: b.bitwiseAND(flips) != 0)
    near = F.array(fp)
    for _ in range(radius // 2):
        near = F.array_union(near, F.flatten(F.transform(near, lambda x: F.transform(bits, lambda b: x.bitwiseXOR(b)))))
    return near


def links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct) whose components are those
    of all pairs that differ in ``radius`` bits or fewer. ``radius`` must be even."""
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part"))
            for t, m in enumerate(covering_masks(radius))
        ]
    )
    keys = fingerprints.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.part")
    buckets = keys.groupBy("t", "part").agg(
        F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")
    )
    met = keys.join(buckets.where("n > 1"), ["t", "part"])
    flips = met.groupBy("fp").agg(F.bit_or("varying").alias("flips"))
    near = flips.select("fp", F.explode(neighbours(F.col("fp"), F.col("flips"), radius)).alias("key"))
    # a key has few possible senders: 65 at radius 2
    stars = near.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return stars.select(
        F.explode("fps").alias("a"), F.array_min("fps").alias("b")
    ).where("a <> b").distinct()


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    radius: int = 2,
) -> DataFrame:
    """(id, fingerprint, component_id) for every document.

    A null text counts as empty; texts without words have the fingerprint zero and are linked like
    others; fewer words than a shingle make one shingle; repeated rows stay repeated; null ids never
    name a component unless all its ids are null; an empty table gives an empty result. Other
    columns of the input are not read.
    """
    docs = staged(with_fingerprints(documents, id_column, text_column, words), "fingerprints")
    kinds = staged(docs.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "kinds")
    nodes = components(links(kinds.select("fp"), radius))
    rooted = kinds.join(nodes, kinds["fp"] == nodes["node"], "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # a fingerprint of one document without links needs no look-up
    looked_up = staged(
        rooted.where("n > 1 OR node IS NOT NULL").join(named, "root").select(F.col("fp").alias("_fp"), "component_id"),
        "component-names",
    )
    return docs.join(looked_up, docs["fp"] == looked_up["_fp"], "left").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(read(spark, sf_dir, "documents"))
