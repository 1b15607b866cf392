"""Search queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.functions import text
from sessionlake.operators import postings, search
from sessionlake.plans import model
from sessionlake.plans.catalog import query

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


# Indexes and vectors are tables that an import writes. Here they are written when they are first asked for, and again if the files
# of the conversations are others: the key names those files with their lengths and times.
_WRITTEN: dict[tuple, object] = {}


def _written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], object]) -> object:
    key = (spark.sparkContext.applicationId, cluster.fingerprint(spark, f"{sf_dir}/conversations.parquet"), name)
    if key not in _WRITTEN:
        _WRITTEN[key] = make(f"{cluster.shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[key]


def _items(spark, sf_dir):
    return model.items(spark, sf_dir).filter("tier = 'conversation'")


def _index(spark, sf_dir, stemmed=False) -> postings.Index:
    return _written(spark, sf_dir, f"index-{stemmed}", lambda path: postings.opened(spark, path, _items(spark, sf_dir), stemmed))


def _hashed(spark, sf_dir):
    return _written(spark, sf_dir, "vectors", lambda path: cluster.materialize(_items(spark, sf_dir).select("item_id", search.hash_embedding(F.col("text"), 64).alias("embedding")), "vectors"))


@query("search_index", "SELECT item_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::BIGINT AS words FROM items WHERE tier = 'conversation'")
def search_index(spark, sf_dir):
    _hashed(spark, sf_dir)
    _index(spark, sf_dir)
    return _index(spark, sf_dir, True).units().select("item_id", F.col("len").cast("long").alias("words"))


_X = f"x AS (SELECT item_id, session_id, kind, occurred_at, text, {_TOKENS} AS toks FROM items WHERE tier = 'conversation')"


def _tf(word: str, prefix: bool) -> str:
    return f"len(list_filter(toks, lambda t : {'starts_with(t, ' + repr(word) + ')' if prefix else 't = ' + repr(word)}))"


def _bm25(terms: list[tuple[str, bool]], any_term: bool) -> str:
    """BM25 over the conversation tier."""
    tf = ", ".join(f"{_tf(w, p)} AS tf{k}" for k, (w, p) in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{k} + 0.5) / (df{k} + 0.5))) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avg))" for k in range(len(terms)))
    wanted = (" OR " if any_term else " AND ").join(f"tf{k} > 0" for k in range(len(terms)))
    return f"{_X}, t AS (SELECT *, len(toks) AS dl, {tf} FROM x), g AS (SELECT count(*) AS n, avg(dl) AS avg, {df} FROM t), b AS (SELECT t.*, round({score}, 9) AS score FROM t, g WHERE {wanted})"


@query("search_terms_and", f"WITH {_bm25([('the', False), ('thing', True)], False)} SELECT item_id, score FROM b")
def search_terms_and(spark, sf_dir):
    return _index(spark, sf_dir).matches("the thing").withColumn("score", F.round("score", 9))


@query("search_terms_or", f"WITH {_bm25([('was', False), ('thing', True), ('with', True)], True)} SELECT item_id, score FROM b")
def search_terms_or(spark, sf_dir):
    return _index(spark, sf_dir).matches("was thing with", any_term=True).withColumn("score", F.round("score", 9))


@query("search_prefix", f"WITH {_X} SELECT item_id, {_tf('ther', True)} AS hits FROM x WHERE hits > 0")
def search_prefix(spark, sf_dir):
    return _index(spark, sf_dir).found("ther")[0].select("item_id", F.col("tf0").alias("hits"))


@query("search_phrase", f"WITH {_X} SELECT item_id FROM x WHERE len(list_filter(range(1, len(toks)), lambda k : toks[k] = 'of' AND toks[k + 1] = 'the')) > 0")
def search_phrase(spark, sf_dir):
    return _index(spark, sf_dir).matches("of-the").select("item_id")


@query("bm25_topk", f"WITH {_bm25([('the', False), ('and', False)], True)}, r AS (SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM b) SELECT * FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    found = _index(spark, sf_dir).matches("the and", any_term=True).withColumn("score", F.round("score", 9))
    order = [F.desc("score"), F.col("item_id")]
    return found.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("item_id", "score", "rank")


@query("bm25_stemmed")
def bm25_stemmed(spark, sf_dir):
    return _index(spark, sf_dir, True).lexical("things andi", any_term=True, limit=50).select("item_id", "score", "rank")


@query("snippet_240", "SELECT item_id, CASE WHEN length(t) > 240 THEN left(t, 240) || '...' ELSE t END AS preview FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM items)")
def snippet_240(spark, sf_dir):
    return model.items(spark, sf_dir).select("item_id", text.preview(F.col("text"), 240).alias("preview"))


@query("lexical_snippet", f"""
WITH {_X}, w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM x WHERE {_tf('thing', True)} > 0),
a AS (SELECT *, coalesce(list_position(list_transform(ws, lambda v : starts_with(lower(regexp_replace(v, '^[^\\p{{L}}\\p{{N}}]+', '')), 'thing')), true), 1) AS place FROM w),
f AS (SELECT *, greatest(1, least(place - 4, len(ws) - 23)) AS first FROM a)
SELECT item_id, CASE WHEN first > 1 THEN '...' ELSE '' END || array_to_string(ws[first:first + 23], ' ') || CASE WHEN first + 23 < len(ws) THEN '...' ELSE '' END AS content FROM f
""")
def lexical_snippet(spark, sf_dir):
    return _items(spark, sf_dir).join(_index(spark, sf_dir).matches("thing"), "item_id").select("item_id", search.snippet(F.col("text"), "thing").alias("content"))


_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vector(spark, sf_dir):
    return cluster.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]  # one row


@query("knn_topk_l2", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS distance, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], {_QUERY}::DOUBLE[]), vec_id) AS rank FROM embeddings QUALIFY rank <= 50")
def knn_topk_l2(spark, sf_dir):
    return search.nearest(cluster.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


_TOP = f"SELECT *, list_distance(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) AS d FROM embeddings"


@query("knn_post_filter", f"WITH t AS ({_TOP} ORDER BY d, vec_id LIMIT 50) SELECT vec_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id) AS rank FROM t WHERE label = 3")
def knn_post_filter(spark, sf_dir):
    return search.nearest(cluster.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50, keep=F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("knn_filter_first", f"WITH t AS ({_TOP} WHERE label = 3 ORDER BY d, vec_id LIMIT 10) SELECT vec_id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id) AS rank FROM t")
def knn_filter_first(spark, sf_dir):
    return search.nearest(cluster.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, keep=F.col("label") == 3, filter_first=True).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


def _lists(spark, sf_dir):
    """Two ranked lists over items: by time, and by hash."""
    rows = model.items(spark, sf_dir).filter("tier = 'conversation'").select(F.col("item_id").alias("key"), "kind", text.preview(F.col("text"), 40).alias("content"), "occurred_at", "text_hash")
    left = rows.orderBy("occurred_at", "key").limit(60).withColumn("rank", F.row_number().over(Window.orderBy("occurred_at", "key")))
    right = rows.orderBy(F.desc("occurred_at"), "key").limit(80).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("occurred_at"), "key")))
    return left, right


_FUSED = """
r AS (SELECT item_id AS key, kind, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS content, occurred_at FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM items WHERE tier = 'conversation')),
l AS (SELECT *, row_number() OVER (ORDER BY occurred_at, key) AS rank FROM r QUALIFY rank <= 60),
s AS (SELECT *, row_number() OVER (ORDER BY occurred_at DESC, key) AS rank FROM r QUALIFY rank <= 80),
f AS (SELECT coalesce(l.key, s.key) AS key, l.rank AS lexical_rank, s.rank AS semantic_rank, coalesce(l.kind, s.kind) AS kind, coalesce(l.content, s.content) AS content, coalesce(l.occurred_at, s.occurred_at) AS occurred_at,
  coalesce(CASE WHEN l.kind = 'user' THEN 1.0 ELSE 0.88 END::DOUBLE / (60 + l.rank), 0) + coalesce(0.98::DOUBLE / (60 + s.rank), 0) AS score,
  CASE WHEN l.key IS NOT NULL AND s.key IS NOT NULL THEN 'hybrid' WHEN l.key IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS match_type FROM l FULL JOIN s ON l.key = s.key)""".replace("\\\\", "\\")


@query("rrf_fuse", f"WITH {_FUSED} SELECT key, lexical_rank, semantic_rank, kind, round(score, 9) AS score, match_type FROM f")
def rrf_fuse(spark, sf_dir):
    return search.fuse(*_lists(spark, sf_dir)).select("key", "lexical_rank", "semantic_rank", "kind", F.round("score", 9).alias("score"), "match_type")


@query("recency_bias", f"WITH {_FUSED} SELECT key, round(score * (1 + 0.5 / (1 + greatest(0, date_diff('second', occurred_at, TIMESTAMP '2024-06-01') / 86400.0) / 30)), 9) AS score FROM f")
def recency_bias(spark, sf_dir):
    fused = search.fuse(*_lists(spark, sf_dir))
    return fused.select("key", F.round(search.recency(F.col("score"), F.col("occurred_at"), "2024-06-01", 0.5), 9).alias("score"))


@query("dedupe_by_snippet", f"""
WITH {_FUSED},
p AS (SELECT *, row_number() OVER (ORDER BY lexical_rank IS NULL, (lexical_rank - 1) // 3, score DESC, least(lexical_rank, semantic_rank), key) AS place, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS c FROM f),
g AS (SELECT c, list(key ORDER BY place) AS keys FROM p GROUP BY 1),
q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY place) AS n FROM p)
SELECT key, match_type, place, array_to_string(keys[2:], ',') AS duplicates FROM q JOIN g USING (c) WHERE n = 1 ORDER BY place LIMIT 50
""".replace("\\\\", "\\"))
def dedupe_by_snippet(spark, sf_dir):
    return search.collapse(search.fuse(*_lists(spark, sf_dir)), 50).select("key", "match_type", "place", F.array_join("duplicates", ",").alias("duplicates"))


@query("results_newest", f"WITH {_FUSED} SELECT key, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, score DESC, key) AS place FROM f QUALIFY place <= 30")
def results_newest(spark, sf_dir):
    fused = search.fuse(*_lists(spark, sf_dir))
    order = search.result_order("newest")
    return fused.orderBy(*order).limit(30).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("key", "place")


@query("semantic_candidates", "SELECT item_id FROM items WHERE length(trim(text)) >= 80 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w : regexp_matches(w, '[\\p{L}\\p{N}]'))) >= 8")
def semantic_candidates(spark, sf_dir):
    return model.items(spark, sf_dir).filter(search.semantic_text(F.col("text"))).select("item_id")


_SAID = "CASE ordinal % 3 WHEN 0 THEN ' Syncing threads' WHEN 1 THEN ' a thread' ELSE ' replication' END"


@query("concept_gate", f"SELECT item_id FROM (SELECT item_id, lower(text || {_SAID}) AS l FROM items) WHERE regexp_matches(l, 'thread|conversation') AND regexp_matches(l, 'sync|replic')")
def concept_gate(spark, sf_dir):
    return model.items(spark, sf_dir).withColumn("text", F.concat("text", F.expr(_SAID))).filter(search.passes_concepts(F.col("text"), "sync of threads")).select("item_id")


@query("hybrid_search")
def hybrid_search(spark, sf_dir):
    wanted = search.hash_vector("the thing and the other", 64)
    return search.hybrid(_items(spark, sf_dir), _hashed(spark, sf_dir), "the thing", wanted, 25, recency_bias=0.2, as_of="2024-06-01", index=_index(spark, sf_dir, True))[0].select("key", "match_type", "lexical_rank", "semantic_rank", "score", "place")


@query("hash_embed_256")
def hash_embed_256(spark, sf_dir):
    return model.items(spark, sf_dir).select("item_id", search.hash_embedding(F.col("text")).alias("embedding"))


@query("missing_embeddings_anti", "SELECT item_id FROM items WHERE length(trim(text)) >= 80 AND tier <> 'raw' AND NOT (ordinal % 2 = 0 AND conv_id % 3 <> 0)")
def missing_embeddings_anti(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("semantic_policy", F.when(F.col("tier") == "raw", "never").otherwise("required"))
    have = rows.filter("ordinal % 2 = 0 and conv_id % 3 <> 0").select(F.col("item_id").alias("unit_id"), "text_hash", F.lit("m").alias("model_id"))
    return search.missing_embeddings(rows, have.union(rows.select("item_id", "text_hash", F.lit("other"))), "m").select("item_id")


@query("silhouette_given_labels", """
WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT vec_id, e.label, c.label AS other, list_distance(embedding::DOUBLE[], centre) AS d FROM embeddings e, c),
s AS (SELECT vec_id, any_value(label) AS label, min(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM d GROUP BY 1)
SELECT label, count(*) AS points, round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s GROUP BY 1
""")
def silhouette_given_labels(spark, sf_dir):
    from sessionlake.operators import topics

    points = cluster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("topic_id"), "embedding")
    return topics.silhouettes(points, topics.centroids(points)).groupBy(F.col("topic_id").alias("label")).agg(F.count("*").alias("points"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query("topic_representatives", """
WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT label AS topic_id, vec_id AS item_id, round(list_distance(embedding::DOUBLE[], centre), 6) AS distance FROM embeddings JOIN c USING (label))
SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY distance, item_id) AS place FROM d QUALIFY place <= 5
""")
def topic_representatives(spark, sf_dir):
    from sessionlake.operators import topics

    points = cluster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("topic_id"), "embedding")
    return topics.representatives(points, topics.centroids(points), 5)


@query("topics_kmeans")
def topics_kmeans(spark, sf_dir):
    from sessionlake.operators import topics

    points = cluster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return topics.cluster(points, 4, 12, 4).assignments
