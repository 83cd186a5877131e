"""Mixing sources to target weights with a low-discrepancy schedule.

The words of every source, its documents shuffled, form blocks of equal length. Slot i of the
schedule takes the golden-ratio point i * phi mod 1; the source whose stretch of the cumulative
weights holds the point gives its next block. So every stretch of the schedule holds the sources in
their proportions, and a source that must give more than it has starts again from its first block.
Each source is settled at its target: the block in which it lies is cut there, later slots give
nothing, and a source that the schedule leaves short gives its next blocks behind it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopwise.llm.tables import WORD, digits_for, read, running_before
from stopwise.workspace import staged

# The odd integer nearest 2**31 / phi, and its modulus.
GOLDEN = 1327217885
MODULUS = 1 << 31
REPEATS = 3
STRETCHES = 1024
SEGMENT = 1 << 16
BLOCK = 4096  # words


def source_targets(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) -> number, weight, target, lo, hi (stretch of the unit interval).

    Sources in the order of their ratio of limit to weight: those at their limit come first, and
    the rest share what these leave by weight. The windows run over one row per source.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("number", F.row_number().over(by_name) - 1)
    s = s.withColumn(
        "weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("number") % len(weights)).cast("double")
    )
    total = F.sum("source_size").over(every).cast("double")
    limit = (F.col("source_size") * REPEATS).cast("double")
    before = Window.orderBy(limit / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rest = total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_limit", limit).withColumn("_full", limit * rest_weight <= F.col("weight") * rest)
    left = total - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(every), F.lit(0.0))
    left_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every)
    s = s.withColumn(
        "target",
        F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("weight") * (left / left_weight)),
    )
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return s.select(
        "source",
        "source_size",
        "number",
        "target",
        F.coalesce(F.sum("target").over(past) / total, F.lit(0.0)).alias("lo"),
        F.coalesce(F.sum("target").over(upto) / total, F.lit(0.0)).alias("hi"),
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(number, rank): the source of every slot and the slot's rank among its source's slots."""
    spark = targets.sparkSession
    point = F.col("id") % MODULUS * GOLDEN % MODULUS / float(MODULUS)
    points = spark.range(1, slots + 1).withColumn("point", point)
    points = points.withColumn("stretch", F.floor(F.col("point") * STRETCHES))
    stretches = targets.where("hi > lo").select(
        "number",
        "lo",
        "hi",
        F.explode(
            F.sequence(F.floor(F.col("lo") * STRETCHES), F.least(F.floor(F.col("hi") * STRETCHES), F.lit(STRETCHES - 1)))
        ).alias("stretch"),
    )
    inside = (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    taken = points.join(staged(stretches, "stretches"), "stretch").where(inside)
    taken = taken.select("number", "id", F.floor(F.col("id") / SEGMENT).alias("segment"))
    counts = taken.groupBy("number", "segment").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "number", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    here = Window.partitionBy("number", "segment").orderBy("id")
    return (
        taken.withColumn("r", F.row_number().over(here) - 1)
        .join(offsets, ["number", "segment"])
        .select("number", (F.col("offset") + F.col("r")).alias("rank"))
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document.

    Weights are dealt to the sources by code point, null last, repeating. A null text has size 0;
    documents of size 0 take 0; repeated rows are documents of their own; an empty table gives an
    empty result. Other columns of the input are not read. The taken words of a source are its
    rounded target, whatever the length of a ``block``.
    """
    docs = staged(
        documents.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        ),
        "mix-sizes",
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights), "mix-targets")
    named = docs.join(
        targets.select(F.col("source").alias("_source"), "number", "source_size", "target"),
        docs["source"].eqNullSafe(F.col("_source")),
    ).drop("_source")
    placed = running_before(
        staged(named, "mix-named"), "number", "key", [F.col("doc_id"), F.col("size")],
        F.col("size"), digits_for(docs.count() // 4), "start",
    )
    placed = staged(placed, "mix-placed")
    end = F.col("start") + F.col("size")
    kept = ["doc_id", "source", "size", "source_size", "target"]
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

    # slots that bring a source to its goal; the last of them, on its last lap, is cut there
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * REPEATS)
    goals = targets.where("source_size > 0").withColumn("goal", goal).withColumn("blocks", F.ceil(F.col("source_size") / block))
    goals = goals.withColumn("lap", F.expr("goal div source_size")).withColumn("rest", F.col("goal") % F.col("source_size"))
    goals = goals.withColumn("slots", F.col("lap") * F.col("blocks") + F.ceil(F.col("rest") / block))
    goals = staged(goals.select("number", "blocks", "rest", "slots"), "mix-goals")
    given = schedule(targets, -(-total // block))
    had = staged(given.groupBy("number").agg(F.count("*").alias("had")), "mix-had")
    short = goals.join(had, "number", "left").where(F.coalesce("had", F.lit(0)) < F.col("slots"))
    behind = F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("slots") - 1))
    given = given.unionByName(short.select("number", behind.alias("rank")))
    cut = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    uses = (
        given.join(goals, "number")
        .where(F.col("rank") < F.col("slots"))
        .groupBy("number", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.sum(F.when(cut, 0).otherwise(1)).alias("uses"), F.max(F.when(cut, F.col("rest"))).alias("until"))
    )
    pieces = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    )
    first = F.greatest("start", F.col("block") * block)
    overlap = F.least(end, (F.col("block") + 1) * block) - first
    part = F.when(F.col("until").isNotNull(), F.greatest(F.least(end, F.col("until")) - first, F.lit(0)))
    # documents with words start at different places of their source
    taken = (
        pieces.join(uses, ["number", "block"], "left")
        .groupBy("number", "start", *kept)
        .agg(F.sum(overlap * F.coalesce("uses", F.lit(0)) + F.coalesce(part, F.lit(0))).cast("long").alias("taken"))
        .select(*kept, "taken")
    )
    empty = placed.where("size = 0").select(*kept, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty)


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as rows: every document as often as the mix takes it, rounded to whole documents. A
    document without words stays once. Columns and texts are those of the input, whatever their names;
    doc_id, source and text must be there. Repeated rows of one doc_id share their mean share."""
    mark = "_" * (1 + max((len(c) for c in documents.columns), default=0))  # no column has such a name
    ratio = F.when(F.sum("size") > 0, F.sum("taken") / F.sum("size")).otherwise(F.lit(1.0))
    shares = mix(documents).groupBy(F.col("doc_id").alias(mark)).agg(F.round(ratio).cast("int").alias(mark + "n"))
    joined = documents.join(shares, documents["doc_id"].eqNullSafe(F.col(mark)))
    copies = joined.where(F.col(mark + "n") > 0).withColumn(mark + "k", F.explode(F.sequence(F.lit(1), F.col(mark + "n"))))
    return copies.select(*[documents[c] for c in documents.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


OP8_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1E0 AS weight,
         CAST(3 * source_size AS DOUBLE) AS lim, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM s),
f AS (
  SELECT *, lim * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0E0))
            <= weight * (total - coalesce(sum(lim) OVER b, 0E0)) AS full_up
  FROM n WINDOW b AS (ORDER BY lim / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, CASE WHEN full_up THEN lim ELSE weight * (
           (total - coalesce(sum(CASE WHEN full_up THEN lim END) OVER (), 0E0))
           / sum(CASE WHEN NOT full_up THEN weight END) OVER ()) END AS target
  FROM f),
g AS MATERIALIZED (
  SELECT source, source_size, number, target, least(CAST(round(target) AS BIGINT), 3 * source_size) AS goal FROM t),
w AS (
  SELECT doc_id, d.source, size, source_size, target, goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY number ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
-- a source gives its words in order, again and again, until its goal
SELECT doc_id, size, source_size, target, source,
       CASE WHEN size = 0 THEN CAST(0 AS BIGINT) ELSE CAST((goal // source_size) * size
         + greatest(least(start + size, goal % source_size) - start, 0) AS BIGINT) END AS taken
FROM w
"""
