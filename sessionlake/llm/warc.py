"""Not-modified revisits of web archives, resolved to the response that they stand for.

A revisit is joined to the latest earlier full response of its canonical URL, an
as-of join. Time is cut into buckets: within a bucket a window looks back, and
the last response of all buckets before comes from running maxima over one thin
row per URL and bucket. So a URL that a third of all records share is spread
over its buckets, and no task holds its whole history.

Validators decide whether the response is the one that was not modified: entity
tags if both have one, else dates of modification, else payload digests. The
headers that a not-modified answer may update are taken from the revisit, all
others from the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a 304 answer may carry anew, and query parameters that name no content.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = ["utm_[a-z]+", "gclid", "fbclid", "ref", "sessionid"]
DEFAULT_PORT = r":(80|443)$"


def canonical_url(url: Column) -> Column:
    """Scheme left out, host in lower case without www. and default port, no fragment, no tracking parameters, no trailing slash; null for null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), DEFAULT_PORT, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({'|'.join(TRACKING)})(=|$)"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def folded(headers: Column) -> Column:
    """Headers by lower-cased name; of names that differ in case alone the value of the greatest counts, that with the first small letter. Null is none."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    kept = F.filter(entries, lambda e: ~F.exists(entries, lambda other: (F.lower(other["key"]) == F.lower(e["key"])) & (other["key"] > e["key"])))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


#: Seconds of a bucket of time, and rows beyond which a URL's bucket is cut into finer ones.
BUCKET_SECONDS, BUCKET_ROWS = 3_600, 50_000


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every revisit with the response that it resolves to.

    records: record_id long, url string, ts long (seconds), kind string
    (response or revisit; others are left out), status int, etag string,
    last_modified string, digest string, headers map<string, string>. Full
    responses are those of status 200. Returns record_id, canonical_url, ts,
    response_id, response_ts, outcome and headers. outcome is resolved,
    mismatch (validators differ), unvalidated (no validator on both sides) or
    orphan (no earlier response, or a null url or ts); headers are merged where
    it is resolved, else the revisit's own. A response at the revisit's second
    is not earlier; of responses at one second the greatest record_id counts.
    Repeated revisits stay. Header names are compared in lower case, see
    folded(). Other columns are left out; an empty table gives no rows.

    A URL's bucket of more than bucket_rows rows is cut into parts of equal time
    whose number grows with its rows, down to single seconds.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("url"),
        F.col("ts").cast("long").alias("ts"),
        F.col("kind").alias("kind"),
        F.col("status").alias("status"),
        F.struct(F.col("etag").alias("etag"), F.col("last_modified").alias("modified"), F.col("digest").alias("digest")).alias("mark"),
        folded(F.col("headers")).alias("headers"),
    ).filter("kind = 'revisit' or (kind = 'response' and status = 200 and url is not null and ts is not null)")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "mark", F.to_json("headers").alias("headers")))
    timed = rows.withColumn("span", F.floor(F.col("ts") / bucket_seconds))
    crowded = timed.groupBy("url", "span").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("url", "span", F.least(F.ceil(F.col("n") / bucket_rows), F.lit(bucket_seconds)).alias("parts"))
    part = F.floor((F.col("ts") - F.col("span") * bucket_seconds) * F.coalesce("parts", F.lit(1)) / bucket_seconds)
    dealt = timed.join(crowded, ["url", "span"], "left").withColumn("bucket", F.col("span") * bucket_seconds + part).drop("span", "parts").withColumn("full", full)
    last = dealt.filter("kind = 'response'").groupBy("url", "bucket").agg(F.max("full").alias("last"))
    # rows for the buckets of revisits too, so that each finds what came before it
    asked = dealt.filter("kind = 'revisit'").select("url", "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    before = last.unionByName(asked).groupBy("url", "bucket").agg(F.max("last").alias("last"))
    carried = before.select("url", "bucket", F.max("last").over(Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.max("full").over(inside)).filter("kind = 'revisit'").drop("full")
    found = near.join(carried, ["url", "bucket"], "left").withColumn("base", F.coalesce("near", "carried"))

    def agree(field: str) -> Column:
        return F.col(f"mark.{field}") == F.col(f"base.mark.{field}")

    same = F.coalesce(agree("etag"), agree("modified"), agree("digest"))
    outcome = F.when(F.col("base").isNull(), "orphan").otherwise(F.when(same, "resolved").when(~same, "mismatch").otherwise("unvalidated"))
    base_headers = F.coalesce(F.from_json("base.headers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(base_headers, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    return found.withColumn("outcome", outcome).select("record_id", F.col("url").alias("canonical_url"), "ts", F.col("base.record_id").alias("response_id"), F.col("base.ts").alias("response_ts"), "outcome", F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))
