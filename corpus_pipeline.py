"""Cleaning and packing a corpus: each stage works on what its predecessor kept, and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import packing, secrets, similar, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of those that are not held out, scores below one half.

    A null text is empty and scored as such. Rows that repeat and null ids are
    judged each for itself. Without labels the model is its prior. An empty table
    stays empty.
    """
    cluster.ship(spark)
    own = docs.select(COLUMNS)
    return toxicity.keep_clean(own, toxicity.train(own, cluster.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of least id, a null id last.

    A document is an id and a text: rows of one id with texts that are not alike
    all stay, rows that repeat in both are one. All empty texts are one group. An
    empty table stays empty.
    """
    cluster.ship(spark)
    return similar.keep_one(docs.select(COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and n_chars counted anew where there were any.

    Findings are joined by the text's address, so null and repeated ids lose
    their own secrets. A null text stays null. An empty table stays empty.
    """
    cluster.ship(spark)
    own = docs.select(COLUMNS)
    found = secrets.scan(own, ["doc_id"]).ledger.filter(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    joined = own.withColumn("_own", secrets.blob_name(F.col("text"))).join(found, F.col("_own") == F.col("_blob"), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("_spans")))
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; null texts are empty documents, null and repeated ids stay, an empty table gives no rows."""
    cluster.ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: SQL can express none of the learned scores, sketches, spans or token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next one. What a stage wrote on its way is deleted when its result is written."""
    docs, before = cluster.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        mark = cluster.mark(spark)
        docs = cluster.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        cluster.discard_since(spark, mark, docs)
        if before is not None:
            cluster.discard(before)
        before = docs
    return docs
