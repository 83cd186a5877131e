"""The sums of an encoding are made in one pass over the rows and written."""

from stopwise.operators import encode


def test_sums_are_made_once(spark, tmp_path):
    rows = [(f"C{i % 7}", i % 3, float(i * i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "category string, fold int, travel_time_seconds double")
    df.write.parquet(f"{tmp_path}/rows")
    read = spark.read.parquet(f"{tmp_path}/rows")
    out = encode.encode_out_of_fold(read, "category", "code")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # once, as the left side of the join with the codes
    assert plan.count(f"{tmp_path}/rows"[:20]) == 1
    assert out.count() == len(rows)
    for category, fold, code in out.select("category", "fold", "code").distinct().collect():
        other = [r[2] for r in rows if r[1] != fold]
        mine = [r[2] for r in rows if r[1] != fold and r[0] == category]
        assert abs(code - (sum(mine) + 20 * sum(other) / len(other)) / (len(mine) + 20)) < 1e-9
    means = encode.category_means(read, "category", "code")
    assert not any(f"{tmp_path}/rows" in f for f in means.inputFiles())
