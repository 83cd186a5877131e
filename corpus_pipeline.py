"""From raw documents to shards: toxic texts go, one of every group of near copies stays, leaked
benchmark passages go, the sources are mixed to their weights, and every row gets its shard.

Each stage works on what the stage before it kept, written as Parquet and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.decontaminate import is_contaminated
from stopwise.llm.mixing import mixed_documents
from stopwise.llm.sharding import shard_documents
from stopwise.llm.simhash import near_duplicates
from stopwise.llm.tables import read, small_batches
from stopwise.llm.toxicity import fit_toxicity, score_toxicity
from stopwise.workspace import staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network fitted on the labels does not call toxic. All rows are scored; null
    and empty texts have a score too; without labels nothing is rejected."""
    small_batches(spark)
    network = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, network).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every component of operator 2: fingerprints that differ
    in 2 or fewer bits are linked. Rows of one doc_id are one document and go or stay together: it stays
    if any of them heads a component, so no text is lost. Rows without a doc_id stay."""
    small_batches(spark)
    heads = F.max(F.col("doc_id") == F.col("component_id"))
    copies = near_duplicates(docs).groupBy("doc_id").agg(heads.alias("heads")).where("NOT heads").select("doc_id")
    # written, so that its size decides how it meets the documents
    return docs.join(staged(copies, "copies"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item. Null and empty texts cover none."""
    small_batches(spark)
    return docs.where(~is_contaminated(F.col("text"), read(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, copies of the mix included."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # a trained network and tilings have no SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
