"""Jump consistent hashing (Lamping and Veach): stable keys to shards without a table of shards.

A generator seeded with the key draws the next shard count at which the key would move; the last
draw below the number of shards is the key's shard. Appending a shard moves 1 in (n + 1) keys, all
of them into the new shard. Everything is column arithmetic: the generator's 64-bit product is built
from two 32-bit halves because SQL's multiplication does not wrap.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.tables import digits_for, read, running_before
from stopwise.workspace import staged

# The multiplier of the generator, split into its high half and its low half less 2**32.
MULTIPLIER = 2862933555777941757
HIGH = MULTIPLIER >> 32
LOW = (MULTIPLIER & 0xFFFFFFFF) - (1 << 32)
MASK = 0xFFFFFFFF


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of an integer key, 0 to shards - 1. A null key counts as key 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(F.lit(MASK)).alias("hi"),
        key.bitwiseAND(F.lit(MASK)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        low = s["lo"] * F.lit(LOW) + F.lit(1).cast("long")
        high = (
            F.shiftright(low, 32)
            + s["lo"]
            + (s["hi"] * F.lit(LOW)).bitwiseAND(F.lit(MASK))
            + (s["lo"] * F.lit(HIGH)).bitwiseAND(F.lit(MASK))
        ).bitwiseAND(F.lit(MASK))
        draw = F.shiftright(high, 1) + F.lit(1).cast("long")
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double")))
        moved = F.struct(
            high.alias("hi"),
            low.bitwiseAND(F.lit(MASK)).alias("lo"),
            s["j"].alias("b"),
            jump.cast("long").alias("j"),
        )
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    # b grows with every step, so there are at most as many steps as shards
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def with_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (the shard with one shard more). No shuffle."""
    return df.withColumn("shard", jump_shard(F.col(key), shards)).withColumn(
        "grown_shard", jump_shard(F.col(key), shards + 1)
    )


def with_slots(sharded: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in every shard, in the order of a digest of the row.

    Equal rows are counted first and share a run of slots, so that no key, however often it
    occurs, gathers its rows in one window.
    """
    columns = sharded.columns
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    rows = sharded.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_key", F.md5(text))
    rows = staged(rows, "shard-rows")
    order = [F.col(c) for c in columns]
    rows = running_before(
        rows, "shard", "_key", order, F.col("_n"), digits_for(rows.count() // 4), "_first"
    )
    return rows.select(
        *columns,
        F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"),
    )


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every document under the law ``key``.

    A null text has no bytes; a null doc_id goes with key 0; repeated rows get slots of their own;
    an empty table gives an empty result. Other columns of the input are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return with_slots(with_shards(rows, "doc_id", shards)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
