"""op9: every document's fingerprint and component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import simhash


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, null texts as empty ones; null and repeated ids stay, an empty table gives no rows."""
    found = simhash.near_duplicates(cluster.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
