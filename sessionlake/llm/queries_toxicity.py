"""op7: a score of every document, learned from labels that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import toxicity


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; a null text is empty, and a null id is held out or not by the empty text. Without labels the scores are the prior's."""
    docs = cluster.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, cluster.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
