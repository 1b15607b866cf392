"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionlake import cluster
from sessionlake.llm import queries_bpe, queries_chat, queries_neighbours, queries_packing, queries_secrets, queries_simhash, queries_tiff, queries_toxicity, queries_urls, queries_warc


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cluster.ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _shipped(queries_secrets.op1_secret_scan),
    "secret_ledger": _shipped(queries_secrets.secret_ledger),
    "op2_byte_bpe": _shipped(queries_bpe.op2_byte_bpe),
    "op3_tiff_pages": _shipped(queries_tiff.op3_tiff_pages),
    "op4_warc_revisits": queries_warc.op4_warc_revisits,
    "op5_url_filter": _shipped(queries_urls.op5_url_filter),
    "op6_nnls_packing": _shipped(queries_packing.op6_nnls_packing),
    "op7_toxicity": _shipped(queries_toxicity.op7_toxicity),
    "op8_chat_formatting": queries_chat.op8_chat_formatting,
    "op9_simhash": _shipped(queries_simhash.op9_simhash),
    "op10_nearest": _shipped(queries_neighbours.op10_nearest),
}

ORACLES: dict[str, str] = {
    "secret_ledger": queries_secrets.LEDGER_SQL,
    "op4_warc_revisits": queries_warc.ORACLE,
    "op8_chat_formatting": queries_chat.ORACLE,
}
