"""op6: all documents packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster
from sessionlake.llm import packing


def op6_nnls_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document, null texts as empty ones, in pieces of sequences of 2048; an empty table gives no rows."""
    return packing.pack_documents(cluster.table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
