"""op1: secrets of every document, from an empty ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import secrets


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans, null texts as empty ones. Null and repeated ids stay; an empty table gives no rows."""
    found = secrets.scan(cluster.table(spark, sf_dir, "documents"), ["doc_id"]).paths
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(kind) for kind in secrets.BASE], F.sha2(F.encode(secrets.listed(base), "UTF-8"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, commit, text): two commits of the documents; the second has half of them as they were and the others with a line more."""
    docs = cluster.table(spark, sf_dir, "documents")
    later = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\nsecret = changed-"), "doc_id"))
    return docs.select("doc_id", F.lit("first").alias("commit"), "text").union(docs.select("doc_id", F.lit("second"), later))


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions each commit has, and how many blobs it had to scan: those that no earlier commit holds."""
    found, _, added = secrets.history(versions(spark, sf_dir), ["doc_id"], "commit", ["first", "second"])
    out = None
    for name, rows in zip(("first", "second"), added):
        one = found.filter(F.col("commit") == name).agg(F.count("*").alias("versions")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("scanned")))).select(F.lit(name).alias("commit"), "versions", "scanned")
        out = one if out is None else out.union(one)
    return out


LEDGER_SQL = """
WITH v AS (SELECT doc_id, 'first' AS "commit", coalesce(text, '') AS text FROM documents UNION ALL SELECT doc_id, 'second', coalesce(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || chr(10) || 'secret = changed-' || doc_id END, '') FROM documents),
f AS (SELECT sha256(text) AS blob, min("commit") AS first_in FROM v GROUP BY 1)
SELECT "commit", count(*) AS versions, (SELECT count(*) FROM f WHERE first_in = v."commit") AS scanned FROM v GROUP BY 1
"""
