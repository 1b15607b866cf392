"""Import, export, pruning and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.operators import filters, maintenance
from sessionlake.plans import model
from sessionlake.plans.catalog import query


@query("import_dedupe", "SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS inserted, 2 * count(*) - count(*) FILTER (o_orderkey % 3 <> 0) AS duplicates, 0 AS conflicts FROM orders")
def import_dedupe(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"))
    return maintenance.import_records(rows.filter("id % 3 = 0"), rows.union(rows))[1]


@query("import_appended", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def import_appended(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"))
    return maintenance.checked(rows.filter("id % 3 = 0"), rows.union(rows)).select("id")


@query("session_upsert", "SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN 'new ' || session_id ELSE 'old' END AS title, last_event_at + CASE WHEN conv_id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated_at FROM facts")
def session_upsert(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    old = facts.select("session_id", F.lit("old").alias("title"), F.col("last_event_at").alias("updated_at"), F.lit("{}").alias("metadata_json"))
    even = F.col("conv_id") % 2 == 0
    new = facts.select("session_id", F.when(even, F.concat(F.lit("new "), "session_id")).otherwise(" ").alias("title"), (F.col("last_event_at") + F.when(even, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL -1 DAY"))).alias("updated_at"), F.lit('{"workspace_path": "/w"}').alias("metadata_json"))
    return maintenance.upsert_sessions(old, new).select("session_id", "title", "updated_at")


@query("activity_incremental", "SELECT session_id, count(*) AS event_count, min(occurred_at) AS first_event_at, max(occurred_at) AS last_event_at FROM items GROUP BY 1")
def activity_incremental(spark, sf_dir):
    items = model.items(spark, sf_dir)
    return maintenance.activity(items.filter("ordinal >= 3"), maintenance.activity(items.filter("ordinal < 3")))


@query("export_closure", "SELECT 'sessions' AS name, count(*) AS rows FROM facts WHERE workspace = '/ws/p3' UNION ALL SELECT 'items', count(*) FROM items WHERE workspace = '/ws/p3' UNION ALL SELECT 'sources', count(DISTINCT source_kind) FROM facts WHERE workspace = '/ws/p3'")
def export_closure(spark, sf_dir):
    facts, items = model.facts(spark, sf_dir), model.items(spark, sf_dir)
    sources = facts.select("source_kind").distinct()
    parts = maintenance.export_closure(facts, facts.filter("workspace = '/ws/p3'"), {"items": (items, "session_id"), "sources": (sources, "source_kind")})
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


@query("prune_selection", "SELECT session_id FROM facts WHERE source_kind IN ('codex', 'omp') AND last_event_at < TIMESTAMP '2024-01-04'")
def prune_selection(spark, sf_dir):
    return filters.prunable(model.facts(spark, sf_dir).withColumn("latest", F.col("last_event_at")), source_kinds=["codex", "omp"], before="2024-01-04").select("session_id")


_PRUNED = "(SELECT session_id FROM facts WHERE workspace = '/ws/p1')"


@query("prune_plan_counts", f'SELECT \'sessions\' AS "table", count(*) AS rows, 0::BIGINT AS bytes FROM facts WHERE session_id IN {_PRUNED} UNION ALL SELECT \'items\', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM items WHERE session_id IN {_PRUNED} UNION ALL SELECT \'provenance\', count(*), 0 FROM provenance WHERE session_id IN {_PRUNED}')
def prune_plan_counts(spark, sf_dir):
    facts, items = model.facts(spark, sf_dir), model.items(spark, sf_dir)
    chosen = filters.prunable(facts, scope="/ws/p1")
    return maintenance.prune_plan(chosen, {"sessions": facts, "items": items, "provenance": model.provenance(spark, sf_dir)}, {"items": "text"})


@query("pruned_items", f"SELECT item_id FROM items WHERE session_id NOT IN {_PRUNED}")
def pruned_items(spark, sf_dir):
    return maintenance.pruned(model.items(spark, sf_dir), filters.prunable(model.facts(spark, sf_dir), basename="p1")).select("item_id")


@query("unresolved_machines", "SELECT machine_id, count(DISTINCT session_id) AS sessions FROM items WHERE machine_id <> 'm0' GROUP BY 1")
def unresolved_machines(spark, sf_dir):
    machines = spark.createDataFrame([("m0",)], "machine_id string")
    return model.items(spark, sf_dir).join(F.broadcast(machines), "machine_id", "left_anti").groupBy("machine_id").agg(F.count_distinct("session_id").alias("sessions"))


@query("machine_reassignment", "SELECT item_id, CASE WHEN source_kind = 'codex' THEN 'm9' ELSE machine_id END AS machine_id FROM items")
def machine_reassignment(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("source_id", F.col("source_kind"))
    return maintenance.reassign_machine(rows, spark.createDataFrame([("codex",)], "source_id string"), "m9").select("item_id", "machine_id")


@query("title_updates", "SELECT session_id, CASE WHEN conv_id % 4 = 1 THEN 'title 2' ELSE 'none' END AS title FROM facts")
def title_updates(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    sessions = facts.select("session_id", "source_kind", F.col("session_id").alias("external_id"), F.lit("none").alias("title"))
    index = facts.filter("source_kind = 'claude_code'").select("source_kind", F.col("session_id").alias("external_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line")).withColumn("title", F.when(F.col("line") < 3, F.concat(F.lit("title "), "line")).otherwise(" "))
    return maintenance.titled(sessions, index).select("session_id", "title")


@query("short_refs", """
WITH h AS (SELECT item_id, sha256(item_id) AS h FROM items), p AS (SELECT item_id, left(h, n::INT) AS ref, n FROM h, range(4, 17) r(n)),
a AS (SELECT *, count(*) OVER (PARTITION BY ref) AS c FROM p) SELECT item_id, arg_min(ref, n) AS ref FROM a WHERE c = 1 GROUP BY 1
""")
def short_refs(spark, sf_dir):
    return maintenance.short_refs(model.items(spark, sf_dir), "item_id")


@query("preflight_estimate", "SELECT count(*) AS records, ((sum(least(length(text), 2000)) + count(*) * 300) // 4)::BIGINT AS tokens FROM items")
def preflight_estimate(spark, sf_dir):
    return maintenance.embedding_cost(model.items(spark, sf_dir))


@query("archive_stats", "SELECT 'sessions' AS name, count(*) AS rows FROM facts UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def archive_stats(spark, sf_dir):
    rows = {"sessions": model.facts(spark, sf_dir), "items": model.items(spark, sf_dir), "embeddings": cluster.table(spark, sf_dir, "embeddings")}
    out = None
    for name, df in rows.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


@query("latest_artifacts", "SELECT source, arg_max(doc_id, doc_id) AS doc_id FROM documents GROUP BY 1")
def latest_artifacts(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("hash"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at"), "doc_id")
    return maintenance.latest_artifacts(rows).select(F.col("path").alias("source"), "doc_id")


@query("append_compaction", "SELECT doc_id, true AS goes FROM documents WHERE length(text) > 1")
def append_compaction(spark, sf_dir):
    docs = cluster.table(spark, sf_dir, "documents").filter("char_length(text) > 1")
    data = F.encode("text", "UTF-8")
    versions = docs.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(F.struct(F.lit("a").alias("v"), F.substring(data, F.lit(1), (F.octet_length("text") / 2).cast("int")).alias("content"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at")), F.struct(F.lit("b").alias("v"), data.alias("content"), F.lit("2024-01-02").cast("timestamp").alias("first_seen_at")))).alias("x")).select("path", F.concat("path", "x.v").alias("hash"), "x.content", "x.first_seen_at")
    return maintenance.compaction(versions).select(F.col("path").cast("long").alias("doc_id"), F.lit(True).alias("goes"))


@query("reconcile_unchanged", "SELECT count(*) FILTER (ordinal >= 3) AS added, 0 AS removed, count(*) FILTER (ordinal < 3 AND conv_id % 2 = 0) AS unchanged, count(*) FILTER (ordinal < 3 AND conv_id % 2 = 1) AS changed FROM items")
def reconcile_unchanged(spark, sf_dir):
    from sessionlake.streaming import incremental

    items = model.items(spark, sf_dir)
    old = items.filter("ordinal < 3").select("item_id", F.when(F.col("conv_id") % 2 == 0, F.col("text_hash")).otherwise("old").alias("hash"))
    diff = incremental.reconcile(old, items.select("item_id", F.col("text_hash").alias("hash")), "item_id", "hash")
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "unchanged", "changed")])


@query("export_since", "SELECT session_id FROM facts WHERE source_kind = 'codex' AND last_event_at >= TIMESTAMP '2024-01-03'")
def export_since(spark, sf_dir):
    rows = model.facts(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp")).withColumn("started_at", F.col("first_event_at"))
    return maintenance.exportable(rows, source_kinds=["codex"], since="2024-01-03").select("session_id")


@query("freshness_probe", "SELECT 'f' || doc_id AS path, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS raw_current, doc_id % 7 = 0 AS needs_workspace_refresh FROM documents")
def freshness_probe(spark, sf_dir):
    docs = cluster.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), F.md5("text").alias("cursor"))
    read = docs.filter("doc_id % 5 <> 0").withColumn("cursor", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("cursor")))
    bare = docs.select("path", F.when(F.col("doc_id") % 7 != 0, "w").alias("workspace"))
    return maintenance.freshness(docs, read, bare)


@query("repository_prefix_join", "SELECT session_id FROM facts WHERE workspace = '/ws/p2'")
def repository_prefix_join(spark, sf_dir):
    return maintenance.in_roots(model.facts(spark, sf_dir), spark.createDataFrame([("/ws/p2/",), ("/elsewhere",)], "root string"), "workspace").select("session_id")


@query("report_snapshot", """
SELECT 'models' AS part, coalesce(primary_model, 'unknown') AS name, sum(coalesce(input_tokens, 0) + coalesce(cached_input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS value FROM facts GROUP BY 2 HAVING value > 0
UNION ALL SELECT 'mix', strftime(first_event_at, '%Y-%m') || ' ' || source_kind, count(*) FROM facts GROUP BY 2
""")
def report_snapshot(spark, sf_dir):
    from sessionlake.operators import report

    facts = model.facts(spark, sf_dir)
    row = report.snapshot({"models": report.tokens_by_model(facts), "mix": report.mix_by_month(facts, "source_kind")}, "2024-02-01")
    read = row.select(F.from_json("report_json", "struct<models: array<struct<model: string, tokens: bigint>>, mix: array<struct<month: string, name: string, sessions: bigint>>>").alias("r"))
    models = read.select(F.explode("r.models").alias("x")).select(F.lit("models").alias("part"), F.col("x.model").alias("name"), F.col("x.tokens").alias("value"))
    return models.union(read.select(F.explode("r.mix").alias("x")).select(F.lit("mix"), F.concat_ws(" ", "x.month", "x.name"), F.col("x.sessions")))


@query("history_health", "SELECT count(*) = 0 AS ready, count(*) AS missing FROM items WHERE kind IN ('user', 'assistant') AND trim(text) <> '' AND tier <> 'conversation'")
def history_health(spark, sf_dir):
    from sessionlake.operators import lookups

    rows = model.items(spark, sf_dir).withColumn("event_id", F.col("item_id"))
    return lookups.history_health(rows.withColumn("role", F.col("kind")).withColumn("content", F.col("text")), rows)


@query("source_status", "SELECT source_kind, sum(s)::BIGINT AS sessions, sum(i)::BIGINT AS items FROM (SELECT source_kind, 1 AS s, 0 AS i FROM facts UNION ALL SELECT source_kind, 0, 1 FROM items) GROUP BY 1")
def source_status(spark, sf_dir):
    from sessionlake.operators import lookups

    return lookups.status({"sessions": model.facts(spark, sf_dir), "items": model.items(spark, sf_dir)})


@query("native_suffix_lookup", "SELECT session_id FROM facts WHERE source_kind = 'omp' AND conv_id = 7")
def native_suffix_lookup(spark, sf_dir):
    from sessionlake.operators import lookups

    return lookups.by_native_suffix(model.facts(spark, sf_dir).withColumn("external_id", F.concat(F.lit("dir_"), "conv_id")), "7").select("session_id")


@query("latest_annotations", "SELECT count(*) AS rows FROM labels WHERE doc_id % 11 <> 0")
def latest_annotations(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit("v1").alias("annotator_version"), F.lit("2024-01-01").alias("annotated_at")), F.struct(F.lit("v2").alias("annotator_version"), F.lit("2024-02-01").alias("annotated_at")))).alias("v")).select("doc_id", "v.*")
    return maintenance.latest_annotations(rows.filter("not (annotator_version = 'v2' and doc_id % 11 = 0)")).agg(F.count("*").alias("rows"))
