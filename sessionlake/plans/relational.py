"""Filters, joins, windows, sorts, set operations and look-ups over the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.functions import dates, ids, text
from sessionlake.operators import filters, sequences
from sessionlake.plans import model
from sessionlake.plans.catalog import query

_THREADS = """
t AS (SELECT f.session_id, source_kind, workspace, event_count, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE last_event_at END AS latest, 'machine ' || (conv_id % 3) AS machine FROM facts f)"""


def _threads(spark, sf_dir):
    machines = spark.createDataFrame([(f"m{k}", f"machine {k}") for k in range(3)], "machine_id string, machine string")
    facts = model.facts(spark, sf_dir).withColumn("machine_id", F.concat(F.lit("m"), F.col("conv_id") % 3))
    return facts.join(F.broadcast(machines), "machine_id", "left").select("session_id", "source_kind", "workspace", "event_count", F.when(F.col("conv_id") % 9 != 0, F.col("last_event_at")).alias("latest"), "machine")


@query("threads_newest", f"WITH {_THREADS} SELECT * FROM t ORDER BY latest DESC NULLS LAST, session_id DESC LIMIT 40")
def threads_newest(spark, sf_dir):
    return _threads(spark, sf_dir).orderBy(F.desc_nulls_last("latest"), F.desc("session_id")).limit(40)


@query("threads_oldest", f"WITH {_THREADS} SELECT * FROM t ORDER BY latest NULLS FIRST, session_id LIMIT 40")
def threads_oldest(spark, sf_dir):
    return _threads(spark, sf_dir).orderBy(F.asc_nulls_first("latest"), "session_id").limit(40)


@query("thread_activity", "SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS event_count, min(ts) AS first_event_at, max(ts) AS last_event_at FROM events GROUP BY 1, 2")
def thread_activity(spark, sf_dir):
    return cluster.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("event_count"), F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"))


@query("last_activity_greatest", "SELECT session_id, greatest(last_event_at, CASE WHEN conv_id % 2 = 0 THEN first_event_at + INTERVAL 1 DAY END, first_event_at) AS last_activity FROM facts")
def last_activity_greatest(spark, sf_dir):
    return model.facts(spark, sf_dir).select("session_id", F.greatest("last_event_at", F.when(F.col("conv_id") % 2 == 0, F.col("first_event_at") + F.expr("INTERVAL 1 DAY")), "first_event_at").alias("last_activity"))


@query("workspace_scope_filter", "SELECT session_id FROM facts WHERE workspace = '/ws/p3' OR starts_with(workspace, '/ws/p3/')")
def workspace_scope_filter(spark, sf_dir):
    meta = model.facts(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(F.col("workspace").alias("cwd"))))
    return meta.filter(filters.in_scope(filters.metadata_paths(F.col("metadata")), "/ws/p3/")).select("session_id")


@query("workspace_basename_filter", "SELECT session_id FROM facts WHERE workspace = 'p5' OR ends_with(workspace, '/p5')")
def workspace_basename_filter(spark, sf_dir):
    return model.facts(spark, sf_dir).filter(filters.has_basename(F.col("workspace"), "p5")).select("session_id")


@query("project_ilike_filter", "SELECT session_id FROM facts WHERE workspace ILIKE '%WS_P2%'")
def project_ilike_filter(spark, sf_dir):
    return model.facts(spark, sf_dir).filter(filters.project_like(F.col("workspace"), "WS_P2")).select("session_id")


@query("time_window_filter", "SELECT item_id FROM items WHERE occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-03'")
def time_window_filter(spark, sf_dir):
    from sessionlake.operators import report

    return model.items(spark, sf_dir).filter(report.between(F.col("occurred_at"), "2024-01-02", "2024-01-03")).select("item_id")


@query("overlap_window_filter", "SELECT session_id FROM facts WHERE last_event_at >= TIMESTAMP '2024-01-02' AND first_event_at < TIMESTAMP '2024-01-04'")
def overlap_window_filter(spark, sf_dir):
    from sessionlake.operators import report

    return model.facts(spark, sf_dir).filter(report.overlaps(F.col("first_event_at"), F.col("last_event_at"), "2024-01-02", "2024-01-04")).select("session_id")


@query("machine_semi_filter", "SELECT item_id FROM items WHERE machine_id = 'm1'")
def machine_semi_filter(spark, sf_dir):
    machines = spark.createDataFrame([(f"m{k}", f"Machine {k}") for k in range(3)], "id string, name string")
    return filters.machine(model.items(spark, sf_dir), machines, "MACHINE 1").select("item_id")


@query("tier_filter", "SELECT tier, count(*) AS n FROM items WHERE tier IN ('conversation', 'tool') GROUP BY 1")
def tier_filter(spark, sf_dir):
    return model.items(spark, sf_dir).filter(F.col("tier").isin(filters.corpora("messages, tools,conversation"))).groupBy("tier").agg(F.count("*").alias("n"))


@query("instruction_filter", "SELECT item_id FROM items WHERE kind IN ('system', 'developer') OR contains(text, '<instructions>')")
def instruction_filter(spark, sf_dir):
    return model.items(spark, sf_dir).filter(filters.instructions(F.col("kind"), F.col("text"))).select("item_id")


@query("term_post_filter", "SELECT item_id FROM items WHERE contains(lower(text), 'thing') AND contains(lower(text), 'the')")
def term_post_filter(spark, sf_dir):
    return model.items(spark, sf_dir).filter(filters.has_terms(F.col("text"), ["THING", "the"])).select("item_id")


@query("sha_prefix_join", "SELECT l.session_id, r.session_id AS other FROM (SELECT session_id, md5(session_id) AS sha FROM facts) l JOIN (SELECT session_id, left(md5(session_id), 6 + conv_id % 3) AS short FROM facts) r ON starts_with(l.sha, r.short)")
def sha_prefix_join(spark, sf_dir):
    rows = model.facts(spark, sf_dir).withColumn("sha", F.md5("session_id"))
    spread = rows.select("session_id", F.explode(filters.sha_prefixes(F.col("sha"))).alias("short"))
    return spread.join(rows.select(F.col("session_id").alias("other"), F.expr("left(sha, int(6 + conv_id % 3))").alias("short")), "short").select("session_id", "other")


@query("project_labels", "SELECT DISTINCT workspace, regexp_extract(workspace, '([^/]+)/*$', 1) AS label FROM facts")
def project_labels(spark, sf_dir):
    return model.facts(spark, sf_dir).select("workspace", text.path_label(F.col("workspace")).alias("label")).distinct()


@query("hits_enriched_inner", "SELECT i.item_id, f.source_kind, f.event_count FROM items i JOIN facts f USING (session_id) WHERE contains(i.text, 'thing')")
def hits_enriched_inner(spark, sf_dir):
    hits = model.items(spark, sf_dir).filter(F.contains("text", F.lit("thing"))).select("item_id", "session_id")
    return hits.join(model.facts(spark, sf_dir), "session_id").select("item_id", "source_kind", "event_count")


@query("orphan_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def orphan_anti_join(spark, sf_dir):
    return cluster.table(spark, sf_dir, "customer").join(cluster.table(spark, sf_dir, "orders").filter("o_totalprice > 250000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("orphan_sources_multi_anti", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_extendedprice > 104800) AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def orphan_sources_multi_anti(spark, sf_dir):
    lines = cluster.table(spark, sf_dir, "lineitem").filter("l_extendedprice > 104800").select("l_suppkey").distinct()
    rich = cluster.table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select("c_nationkey").distinct()
    own = cluster.table(spark, sf_dir, "supplier")
    return own.join(lines, own.s_suppkey == lines.l_suppkey, "left_anti").join(rich, F.col("s_nationkey") == rich.c_nationkey, "left_anti").select("s_suppkey")


@query("machine_exists_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def machine_exists_semi(spark, sf_dir):
    lines = cluster.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return cluster.table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, max(o_orderdate) AS latest_at FROM orders GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return cluster.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"), F.max("o_orderdate").alias("latest_at"))


@query("status_counts_union", "SELECT source_kind, sum(sessions)::BIGINT AS sessions, sum(items)::BIGINT AS items, sum(events)::BIGINT AS events FROM (SELECT source_kind, count(*) AS sessions, 0 AS items, 0 AS events FROM facts GROUP BY 1 UNION ALL SELECT source_kind, 0, count(*), 0 FROM items GROUP BY 1 UNION ALL SELECT source_kind, 0, 0, sum(event_count) FROM facts GROUP BY 1) GROUP BY 1")
def status_counts_union(spark, sf_dir):
    facts, items = model.facts(spark, sf_dir), model.items(spark, sf_dir)
    zero = F.lit(0).cast("long")
    parts = facts.groupBy("source_kind").agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events")).withColumn("items", zero).unionByName(items.groupBy("source_kind").agg(F.count("*").alias("items")).withColumn("sessions", zero).withColumn("events", zero))
    return parts.groupBy("source_kind").agg(*[F.sum(c).alias(c) for c in ("sessions", "items", "events")])


@query("status_counts_approximate", "SELECT source_kind, count(*) AS sessions, (((SELECT count(*) FROM items) * count(*) * 2 + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ()))::BIGINT AS approx_items FROM facts GROUP BY 1")
def status_counts_approximate(spark, sf_dir):
    from sessionlake.operators import maintenance

    known = model.items(spark, sf_dir).count()
    return maintenance.proportional(model.facts(spark, sf_dir).groupBy("source_kind").agg(F.count("*").alias("sessions")), "sessions", known, "approx_items")


@query("model_carry_forward", "SELECT item_id, last_value(model IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal, item_id ROWS UNBOUNDED PRECEDING) AS carried_model FROM items QUALIFY carried_model IS NOT NULL")
def model_carry_forward(spark, sf_dir):
    return sequences.carry_model(model.items(spark, sf_dir), "session_id", ["ordinal", "item_id"], "model").filter("carried_model is not null").select("item_id", "carried_model")


@query("line_ranges_islands", "SELECT l_suppkey % 50 AS k, min(l_orderkey) AS first, max(l_orderkey) AS last FROM (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_orderkey) AS run FROM (SELECT DISTINCT l_orderkey, l_suppkey % 50 AS l_suppkey FROM lineitem)) GROUP BY k, run")
def line_ranges_islands(spark, sf_dir):
    return sequences.islands(cluster.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), "l_orderkey"), ["k"], "l_orderkey")


@query("manifest_offsets", "SELECT doc_id, source, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM documents")
def manifest_offsets(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return sequences.offsets(rows, ["source"], ["doc_id"], "size", "byte_offset").select("doc_id", "source", "byte_offset")


@query("manifest_contiguous", "SELECT DISTINCT source, true AS ok FROM documents")
def manifest_contiguous(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    full = rows.groupBy("source").agg(F.sum("size").alias("full"))
    return sequences.contiguous(sequences.offsets(rows, ["source"], ["doc_id"], "size", "byte_offset").join(full, "source"), ["source"], ["doc_id"], "byte_offset", "size", "full")


@query("context_window", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, item_id) AS n FROM items WHERE tier = 'conversation'), a AS (SELECT *, coalesce(min(CASE WHEN ordinal >= 3 THEN n END) OVER (PARTITION BY session_id), max(n) OVER (PARTITION BY session_id)) AS anchor FROM r) SELECT item_id, (n - anchor)::BIGINT AS place FROM a WHERE n - anchor BETWEEN -1 AND 2")
def context_window(spark, sf_dir):
    rows = model.items(spark, sf_dir).filter("tier = 'conversation'")
    return sequences.context(rows, "session_id", ["ordinal", "item_id"], F.col("ordinal") >= 3, 1, 2).select("item_id", F.col("place").cast("long").alias("place"))


@query("keyset_page", "SELECT item_id, occurred_at FROM items WHERE occurred_at > TIMESTAMP '2024-01-01 10:02:00' OR (occurred_at = TIMESTAMP '2024-01-01 10:02:00' AND item_id > 'i10-2') ORDER BY occurred_at, item_id LIMIT 26")
def keyset_page(spark, sf_dir):
    at = sequences.cursor({"occurred_at": "2024-01-01 10:02:00", "item_id": "i10-2"}, ["occurred_at", "item_id"])
    return sequences.page(model.items(spark, sf_dir).select("item_id", "occurred_at"), ["occurred_at", "item_id"], 25, at)


@query("evidence_last5", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC)[1:5], ',') AS latest FROM orders GROUP BY 1")
def evidence_last5(spark, sf_dir):
    last = sequences.top_per_group(cluster.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return last.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string")), ",").alias("latest"))


@query("even_stride_sample", "WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS c FROM items) SELECT item_id FROM r WHERE n IN (SELECT i * (SELECT max(c) FROM r) // 30 FROM range(30) t(i))")
def even_stride_sample(spark, sf_dir):
    return sequences.stride_sample(model.items(spark, sf_dir).select("item_id"), ["item_id"], 30)


@query("first_last_per_session", "SELECT session_id, arg_min(text_hash, ordinal) AS first_hash, arg_max(text_hash, ordinal) AS last_hash FROM items GROUP BY 1")
def first_last_per_session(spark, sf_dir):
    return model.items(spark, sf_dir).groupBy("session_id").agg(F.min_by("text_hash", "ordinal").alias("first_hash"), F.max_by("text_hash", "ordinal").alias("last_hash"))


@query("union_distinct_closure", "SELECT workspace AS name FROM facts UNION SELECT source_kind FROM facts UNION SELECT primary_model FROM facts WHERE primary_model IS NOT NULL")
def union_distinct_closure(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    return facts.select(F.col("workspace").alias("name")).union(facts.select("source_kind")).union(facts.filter("primary_model is not null").select("primary_model")).distinct()


@query("word_set_intersection", "SELECT a.session_id, len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[a-z]+')), list_distinct(regexp_extract_all(lower(b.text), '[a-z]+')))) AS shared FROM items a JOIN items b ON a.session_id = b.session_id AND a.ordinal = 0 AND b.ordinal = 1")
def word_set_intersection(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("words", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    a, b = rows.filter("ordinal = 0").select("session_id", F.col("words").alias("x")), rows.filter("ordinal = 1").select("session_id", F.col("words").alias("y"))
    return a.join(b, "session_id").select("session_id", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))


@query("lookup_items_by_session", "SELECT item_id, ordinal FROM items WHERE session_id = 's3' AND tier = 'conversation' ORDER BY ordinal, item_id")
def lookup_items_by_session(spark, sf_dir):
    return model.items(spark, sf_dir).filter("session_id = 's3' and tier = 'conversation'").orderBy("ordinal", "item_id").select("item_id", "ordinal")


@query("max_ordinal_per_session", "SELECT session_id, max(ordinal) AS max_ordinal FROM items GROUP BY 1")
def max_ordinal_per_session(spark, sf_dir):
    return model.items(spark, sf_dir).groupBy("session_id").agg(F.max("ordinal").alias("max_ordinal"))


@query("ids_by_content_hash", "SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1")
def ids_by_content_hash(spark, sf_dir):
    return cluster.table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("canonical")).filter("copies > 1")


@query("stable_ids", "SELECT conv_id, 'sc_' || sha256('session' || chr(0) || source_kind || chr(0) || session_id || chr(0)) AS id FROM facts")
def stable_ids(spark, sf_dir):
    return model.facts(spark, sf_dir).select("conv_id", ids.stable_id(F.lit("session"), F.col("source_kind"), F.col("session_id")).alias("id"))


@query("html_clean", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_clean(spark, sf_dir):
    return cluster.table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("text_chunks", "SELECT doc_id, k::INT AS part, substring(text, k * 1000 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range((length(text) + 999) // 1000)) AS k FROM documents)")
def text_chunks(spark, sf_dir):
    return cluster.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 1000)).alias("part", "chunk"))


@query("json_extract_props", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_extract_props(spark, sf_dir):
    return cluster.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("json_integer_only", "SELECT event_type, sum(CASE WHEN json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT') THEN greatest((props::JSON ->> '$.k')::BIGINT, 0) ELSE 0 END)::BIGINT AS total FROM events GROUP BY 1")
def json_integer_only(spark, sf_dir):
    from sessionlake.operators import derive

    return cluster.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(derive.json_count("props", "$.k")).alias("total"))


@query("json_object_agg", "SELECT session_id, array_to_string(list(model || ':' || n ORDER BY model), ',') AS models FROM (SELECT session_id, model, count(*) AS n FROM items WHERE model IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def json_object_agg(spark, sf_dir):
    by = model.items(spark, sf_dir).filter("model is not null").groupBy("session_id", "model").agg(F.count("*").alias("n"))
    return by.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "n"))).alias("m")).select("session_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("models"))


@query("monday_weeks", "SELECT event_id, strftime(ts, '%Y-%W') AS week FROM events")
def monday_weeks(spark, sf_dir):
    return cluster.table(spark, sf_dir, "events").select("event_id", dates.monday_week(F.col("ts")).alias("week"))


@query("running_total_months", "SELECT month, n, sum(n) OVER (ORDER BY month DESC)::BIGINT AS so_far FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)")
def running_total_months(spark, sf_dir):
    by = cluster.table(spark, sf_dir, "orders").groupBy(dates.month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))
    return by.withColumn("so_far", F.sum("n").over(Window.orderBy(F.desc("month"))))
