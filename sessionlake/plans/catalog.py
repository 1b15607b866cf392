"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is its DuckDB form, over the views of plans.model where it names them."""

    def add(function: Query) -> Query:
        from sessionlake.plans.model import with_views

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            cluster.ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return add


for _module in ("relational", "reporting", "searching", "deriving", "keeping", "upkeep"):
    importlib.import_module(f"sessionlake.plans.{_module}")
