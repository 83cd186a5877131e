"""A stream that is stopped and started again."""

from stopwise.plans.lake import lake
from stopwise.streaming import score


def test_each_row_once_after_a_restart(spark, tmp_path):
    k = lake(spark, "/root/testdata/sf0.001")
    rows = k.get("holdout").drop("travel_time_seconds")
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    parts = rows.randomSplit([1.0, 1.0, 1.0], seed=4)
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        if n == 1:
            continue  # two files arrive while the stream is down
        stream = score.read_segment_stream(spark, source, rows.schema)
        scored = score.score_stream(stream, k.get("lines")).select("route_id", "segment_position", "prediction")
        score.run_to_files(scored, out, state)
    got = [(r.route_id, r.segment_position) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted((r.route_id, r.segment_position) for r in rows.select("route_id", "segment_position").collect())
