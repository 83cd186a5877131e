"""Exact duplicates with two passes over a Bloom filter.

The first pass counts the cells of all hashes; cells hit at least twice make the filter. In the
second pass a row whose cells are all in the filter may be repeated; any other row is certainly the
only one of its kind and passes straight through. Only the rows that may be repeated are grouped.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import bloom
from stopwise.llm.tables import SPACE, read
from stopwise.workspace import staged

HASHES = 2
ADDED = ["keep_id", "group_size", "kept", "text_sha256", "_plain", "_maybe", "_rank", "_sha", "_best"]


def repeated_filter(hashes: DataFrame, size: int) -> DataFrame:
    """One row: the filter of all cells that two rows or more of column ``h`` hit."""
    cells = hashes.select(
        F.explode(F.array_distinct(F.array(*bloom.cells(F.col("h"), size, HASHES)))).alias("cell")
    )
    twice = cells.groupBy("cell").count().where("count > 1")
    return bloom.whole_filter(twice, size)


def exact_dedup(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bits_per_row: int = 16,
    limit_bytes: int = 1 << 24,
) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row; all other columns stay,
    but columns of the input with these names are replaced.

    Texts are equal when they are without their white space; null counts as empty. The row with the
    most code points stays, then the one with the smallest id (a null id last), then the first row.
    ``limit_bytes`` bounds the filter; a filter that is too small only lets more rows be grouped.
    """
    documents = documents.drop(*ADDED)
    text = F.coalesce(F.col(text_column), F.lit(""))
    plain = F.regexp_replace(text, SPACE, "")
    size = bloom.size_for(documents.count(), bits_per_row, limit_bytes)
    pages = repeated_filter(documents.select(F.xxhash64(plain).alias("h")), size).scalar()
    rows = documents.withColumn("_plain", plain).withColumn("text_sha256", F.sha2("_plain", 256))
    cells = bloom.cells(F.xxhash64("_plain"), size, HASHES)
    maybe = bloom.is_set(pages, cells[0])
    for cell in cells[1:]:
        maybe = maybe & bloom.is_set(pages, cell)
    rows = rows.withColumn("_maybe", maybe).drop("_plain")
    single = rows.where("NOT _maybe").select(
        *[F.col(c) for c in documents.columns],
        F.col(id_column).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    rank = F.struct(
        (-F.length(text)).alias("n"),
        F.col(id_column).isNull().alias("none"),
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("at"),
    )
    # written, so that both readings below see the same numbering of rows
    repeated = staged(rows.where("_maybe").withColumn("_rank", rank).drop("_maybe"), "maybe-repeated")
    groups = repeated.groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.min("_rank").alias("_best"), F.count("*").alias("group_size")
    )
    grouped = repeated.join(groups, repeated["text_sha256"] == groups["_sha"]).select(
        *[repeated[c] for c in documents.columns],
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("_rank.at") == F.col("_best.at")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(grouped)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
