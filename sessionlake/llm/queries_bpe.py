"""op2: every text encoded and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster
from sessionlake.llm import bpe


def op2_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document, null texts as empty ones; null and repeated ids stay, an empty table gives no rows."""
    return bpe.digests(cluster.table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
