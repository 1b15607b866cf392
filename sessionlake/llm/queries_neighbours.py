"""op10: the five nearest of every fiftieth vector among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster
from sessionlake.llm import neighbours


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query of the table; a vec_id that repeats is one query and one candidate, unusable vectors are none, an empty table gives no rows."""
    rows = cluster.table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 50 = 0"))
