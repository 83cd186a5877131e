"""Registry of the queries: name -> (callable, SQL or None)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopwise.plans.lake import Lake, lake
from stopwise.plans.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", select: str | None = None):
    """Register ``fn(lake) -> DataFrame`` under ``name`` with its SQL."""

    def keep(fn: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(lake(spark, sf_dir))
        if select is not None:
            ORACLES[name] = sql(needs, select)
        return fn

    return keep


def load_all() -> None:
    from stopwise.plans import (  # noqa: F401
        q_explore,
        q_models,
        q_quality,
        q_scoring,
        q_tables,
    )
