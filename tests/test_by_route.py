"""Tables with a row for each route or stop stay with the executors, however small their files are."""

from stopwise.operators import gold, joins, splits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_route_tables_are_not_broadcast(spark, tmp_path):
    spark.range(200_000).selectExpr("concat('R', id) AS route_id", "id % 50 / 100 AS score").write.parquet(f"{tmp_path}/r")
    routes = spark.read.parquet(f"{tmp_path}/r")
    scores = spark.read.parquet(f"{tmp_path}/r").withColumnRenamed("score", "other")
    for df in (
        gold.assemble_route_table(routes, scores, scores.groupBy("route_id").count()),
        gold.with_route_context(routes.selectExpr("route_id", "1 AS segment_position"), scores),
        joins.in_routes(routes, scores),
        joins.not_in_routes(routes, scores),
        splits.train_routes(routes, scores),
    ):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
    assert gold.assemble_route_table(routes, scores).where("score = other").count() == 200_000


def test_few_routes_are_left_to_catalyst(spark):
    routes = spark.range(100).selectExpr("concat('R', id) AS route_id")
    assert joins.by_route(routes) is routes
    assert joins.by_route(spark.range(1_000_000)) is not routes
