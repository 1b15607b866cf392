"""op4: every page as a capture and as a later not-modified answer for its section of the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import warc

#: Pages are captured a minute apart; the revisit of a page's section comes this many seconds later.
STEP, LATER = 60, 150

#: SQL that both engines read: which validators a page's records have, and whether its capture is a full response.
_CLASS = "length(html) % 3"
_FIELDS = {
    "etag": f"CASE WHEN page_id % 3 = 0 THEN concat('\"', {_CLASS}, '\"') END",
    "last_modified": f"CASE WHEN page_id % 5 < 3 THEN concat('day ', {_CLASS}) END",
    "digest": f"CASE WHEN page_id % 7 < 5 THEN concat('sha1:', {_CLASS}) END",
    "status": "CASE WHEN page_id % 11 = 4 THEN 404 ELSE 200 END",
    # a page in a dozen lies in a section that no capture is of
    "alone": "page_id % 12 = 7",
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of each page: the capture of its section (its URL up to the last slash before the number), and a revisit.

    Each has some of an entity tag, a date of modification and a digest, by the
    page's length; some captures are no full responses, and some revisits are of
    sections that were never captured. Header names differ in case.
    """
    pages = cluster.table(spark, sf_dir, "pages")
    url = F.regexp_extract("url", r"^([^?#]*/)[^/?#]+/?([?#].*)?$", 1)
    section = F.when(url != "", url).otherwise(F.col("url"))
    both = pages.select("page_id", section.alias("section"), *[F.expr(sql).alias(name) for name, sql in _FIELDS.items()], F.explode(F.array(F.lit("response"), F.lit("revisit"))).alias("kind"))
    new = F.col("kind") == "revisit"
    ts = F.col("page_id") * STEP + F.when(new, LATER).otherwise(0)
    return both.select(
        (F.col("page_id") * 2 + new.cast("int")).alias("record_id"),
        F.when(new & F.col("alone"), F.concat("section", F.lit("new/"), "page_id")).otherwise(F.col("section")).alias("url"),
        ts.alias("ts"),
        "kind",
        F.when(new, 304).otherwise(F.col("status")).alias("status"),
        "etag",
        "last_modified",
        "digest",
        F.create_map(F.lit("ETAG"), F.lit("old"), F.lit("ETag"), "etag", F.lit("Date"), ts.cast("string"), F.lit("Server"), F.when(new, "cache").otherwise("origin")).alias("headers"),
    )


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's revisit. A page with a null url has an orphan; an empty table gives no rows."""
    found = warc.resolve(records(spark, sf_dir))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "; ")
    return found.withColumn("headers", listed)


_MARKS = ", ".join(f"{_FIELDS[name]} AS {name}" for name in ("etag", "last_modified", "digest", "status", "alone"))
ORACLE = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN regexp_extract(url, '^([^?#]*/)[^/?#]+/?([?#].*)?$', 1) <> '' THEN regexp_extract(url, '^([^?#]*/)[^/?#]+/?([?#].*)?$', 1) ELSE url END AS section, {_MARKS} FROM pages),
k AS (
  SELECT *, true AS new, CASE WHEN alone THEN section || 'new/' || page_id ELSE section END AS full_url FROM p
  UNION ALL SELECT *, false, section FROM p WHERE status = 200),
c AS (
  SELECT *, regexp_replace(regexp_replace(full_url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM k),
u AS (
  SELECT page_id, new, etag, last_modified, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS url
  FROM c),
v AS (SELECT page_id * 2 + 1 AS record_id, url, page_id * 60 + 150 AS ts, etag, last_modified, digest FROM u WHERE new),
r AS (SELECT page_id * 2 AS record_id, url, page_id * 60 AS ts, etag, last_modified, digest FROM u WHERE NOT new),
j AS (
  SELECT v.record_id, v.url, v.ts, v.etag, r.record_id AS response_id, r.ts AS response_ts, r.etag AS base_etag, coalesce(v.etag = r.etag, v.last_modified = r.last_modified, v.digest = r.digest) AS same
  FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.ts > r.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN same THEN 'resolved' WHEN NOT same THEN 'mismatch' ELSE 'unvalidated' END AS outcome FROM j)
SELECT record_id, url AS canonical_url, ts, response_id, response_ts, outcome,
  'date: ' || ts || coalesce('; etag: ' || etag, '; etag') || '; server: ' || CASE WHEN outcome = 'resolved' THEN 'origin' ELSE 'cache' END AS headers
FROM o
"""
