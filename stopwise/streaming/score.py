"""Scoring of planned segments as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stopwise.operators.scoring import score_lines


def read_segment_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_stream(stream: DataFrame, lines: DataFrame) -> DataFrame:
    """Stateless: the batch function on a stream, so both give the same rows."""
    return score_lines(stream, lines)


def run_to_files(scored: DataFrame, out: str, checkpoint: str) -> None:
    """Score all files present, then stop. The checkpoint makes a restart resume exactly."""
    q = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    q.awaitTermination()
