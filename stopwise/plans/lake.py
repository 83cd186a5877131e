"""Tables of one test-data folder, each written once per application to the shared folder."""

from pyspark.sql import DataFrame, SparkSession

from stopwise.operators import gold
from stopwise.plans import fixtures
from stopwise.workspace import staged

_lakes: dict[tuple[str, str], "Lake"] = {}

SILVER = [
    "keyed_routes",
    "keyed_stops",
    "routes",
    "stops",
    "sequences",
    "packages",
    "segments",
    "weather",
    "holidays",
    "calendar",
    "invalid_scores",
]

# Columns or a filter of one written table: read from it, not written again.
VIEWS = {"stops", "sequences", "model_rows", "train", "holdout", "planned_stops"}


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.written: dict[str, DataFrame] = {}
        self.raw: dict[str, list[str]] = {}

    def get(self, name: str) -> DataFrame:
        """The written table, building it on first use; a view of one where that says it all."""
        if name not in self.written:
            plan = self.plan(name)
            self.written[name] = plan if name in VIEWS else staged(plan, name)
        return self.written[name]

    def plan(self, name: str) -> DataFrame:
        """The lazy plan of a table over the written tables below it."""
        if name in SILVER:
            return fixtures.build(self.spark, self.sf_dir, name, self.get)
        if name == "gold_segments":
            names = ("segments", "stops", "packages", "routes", "weather", "calendar")
            return gold.gold_segments(*[self.get(n) for n in names])
        if name == "gold_routes":
            names = (
                "routes", "invalid_scores", "stops", "packages", "sequences", "weather",
                "calendar", "segments",
            )
            return gold.gold_routes(*[self.get(n) for n in names])
        from stopwise.plans import models

        return models.plan(self, name)


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        _lakes[key] = Lake(spark, sf_dir)
    return _lakes[key]
