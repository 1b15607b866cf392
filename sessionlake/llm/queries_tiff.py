"""op3: every text as a TIFF file and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster
from sessionlake.llm import tiff


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, null texts as empty ones; an empty table gives no rows."""
    return tiff.round_trip(cluster.table(spark, sf_dir, "documents"))
