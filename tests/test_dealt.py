"""The dealing of legs follows the number of rows."""

from stopwise.operators import ordered


def test_tasks_follow_the_rows(spark, monkeypatch):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "REPARTITION_BY_COL" in ordered.dealt(df, "k", [df])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ordered, "DEALT_ROWS", 20_000 // (width + 3))
    many = ordered.dealt(df, "k", [df, df])
    assert many.rdd.getNumPartitions() > width and many.count() == 10_000
