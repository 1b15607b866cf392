"""op5: a verdict for every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster
from sessionlake.llm import urls

RULES = [urls.rule("com/", "allow"), urls.rule("example.com/en/", "block"), urls.rule("www.example.com/en/", "allow"), urls.rule("net/es/", "block"), urls.rule("net/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; a null url has an empty host and path. Null and repeated ids stay, an empty table gives no rows."""
    split = urls.split_pages(cluster.table(spark, sf_dir, "pages"), RULES)
    return urls.judge(split, urls.train(split))
