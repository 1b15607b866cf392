"""Derivations: authors, lineage, tools, commits, blame."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.operators import blame, derive, lineage, maintenance, tools
from sessionlake.plans import model
from sessionlake.plans.catalog import query

_RELATIONS = "rel AS (SELECT session_id, CASE WHEN conv_id % 5 = 0 AND conv_id > 0 THEN 'subagent' ELSE 'none' END AS relationship, CASE WHEN conv_id % 10 = 0 AND conv_id > 0 THEN 's' || (conv_id // 10) END AS parent FROM facts)"


def _relations(spark, sf_dir):
    c = F.col("conv_id")
    return model.facts(spark, sf_dir).select("session_id", "conv_id", F.when((c % 5 == 0) & (c > 0), "subagent").otherwise("none").alias("relationship"), F.when((c % 10 == 0) & (c > 0), F.concat(F.lit("s"), (c / 10).cast("long"))).alias("parent_session_id"))


def _texts(spark, sf_dir):
    """Items some of which begin like the texts that machines write."""
    prefix = F.element_at(F.array(*[F.lit(t) for t, *_ in derive.TAGS]), (F.col("conv_id") % len(derive.TAGS) + 1).cast("int"))
    return model.items(spark, sf_dir).withColumn("text", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("  "), F.upper(prefix), "text")).otherwise(F.col("text")))


_TAGGED = "CASE " + " ".join(f"WHEN starts_with(l, '{t}') THEN '{r}'" for t, _, _, r in derive.TAGS)


@query("provenance_rules", f"""
WITH {_RELATIONS},
t AS (SELECT item_id, session_id, kind, lower(CASE WHEN ordinal % 3 = 0 THEN [{", ".join(f"'{t}'" for t, *_ in derive.TAGS)}][conv_id % {len(derive.TAGS)} + 1] ELSE text END) AS l, conv_id, source_kind FROM items WHERE tier = 'conversation')
SELECT item_id, {_TAGGED} WHEN conv_id % 11 = 0 THEN 'session.automation' WHEN relationship = 'subagent' THEN 'relationship.subagent' WHEN kind = 'assistant' THEN 'message.assistant' ELSE 'default.human' END AS rule FROM t JOIN rel USING (session_id)
""")
def provenance_rules(spark, sf_dir):
    classes = _relations(spark, sf_dir).select("session_id", F.when(F.col("conv_id") % 11 == 0, "automation").otherwise("interactive").alias("session_class"))
    return derive.message_provenance(_texts(spark, sf_dir).withColumn("text_hash", F.md5("item_id")), _relations(spark, sf_dir), classes).select("item_id", "rule")


@query("provenance_audit", "SELECT authored_by, item_id, row_number() OVER (PARTITION BY authored_by ORDER BY md5(item_id || '7'), item_id) AS place FROM provenance QUALIFY place <= 20")
def provenance_audit(spark, sf_dir):
    return derive.audit(model.provenance(spark, sf_dir), 7, 20).select("authored_by", "item_id", "place")


@query("repeated_templates", "SELECT text_hash FROM (SELECT md5(repeat('t' || (conv_id % 6), 150)) AS text_hash, session_id, workspace FROM items WHERE kind = 'user') GROUP BY 1 HAVING count(DISTINCT session_id) > 3 AND count(DISTINCT workspace) > 3")
def repeated_templates(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("text", F.repeat(F.concat(F.lit("t"), F.col("conv_id") % 6), 150))
    return derive.templates(rows.withColumn("text_hash", F.md5("text")))


@query("inherited_items_semi", f"WITH {_RELATIONS}, k AS (SELECT item_id, session_id, kind, ordinal % 3 AS h FROM items) SELECT k.item_id, EXISTS (SELECT 1 FROM k p WHERE p.session_id = r.parent AND p.kind = k.kind AND p.h = k.h) AS inherited FROM k JOIN rel r USING (session_id) WHERE relationship = 'subagent'")
def inherited_items_semi(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("text_hash", F.col("ordinal") % 3)
    return lineage.inherited(rows, _relations(spark, sf_dir))


@query("root_session_closure", f"""
WITH RECURSIVE up AS (SELECT 's' || conv_id AS session_id, 's' || conv_id AS root, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT session_id, 's' || (conv_id // 2), conv_id // 2 FROM up WHERE conv_id > 0 AND conv_id % 2 = 0)
SELECT session_id, arg_min(root, conv_id) AS root_session_id FROM up GROUP BY 1
""")
def root_session_closure(spark, sf_dir):
    c = F.col("conv_id")
    ids = cluster.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return lineage.roots(ids.select(F.concat(F.lit("s"), c).alias("session_id"), F.when((c > 0) & (c % 2 == 0), F.concat(F.lit("s"), (c / 2).cast("long"))).alias("parent_session_id")))


@query("parent_resolution", "SELECT session_id, CASE WHEN conv_id >= 4 THEN 's' || (conv_id - 4) END AS parent_session_id FROM facts")
def parent_resolution(spark, sf_dir):
    c = F.col("conv_id")
    rows = model.facts(spark, sf_dir).select("session_id", F.lit("m").alias("machine_id"), "source_kind", F.concat(F.lit("x"), c).alias("external_id"), F.concat(F.lit("x"), c - 4).alias("parent_external_id"))
    return lineage.parents(rows, rows)


# all sessions begin alike; those of five neighbours go on alike for a while
@query("fork_prefix_candidates", """
WITH p AS (SELECT b.conv_id AS child, a.conv_id AS parent, CASE WHEN a.conv_id // 5 = b.conv_id // 5 THEN 9 + least(a.conv_id % 5, b.conv_id % 5) ELSE 8 END AS common FROM facts a JOIN facts b ON a.conv_id < b.conv_id),
r AS (SELECT *, rank() OVER (PARTITION BY child ORDER BY common DESC) AS r FROM p), s AS (SELECT *, count(*) OVER (PARTITION BY child) AS n FROM r WHERE r = 1)
SELECT 's' || child AS session_id, 's' || parent AS parent_session_id, common FROM s WHERE n = 1
""")
def fork_prefix_candidates(spark, sf_dir):
    c, n = F.col("conv_id"), F.col("n")
    facts = model.facts(spark, sf_dir)
    group = F.floor(c / 5).cast("long")
    name = F.when(n <= 8, F.concat_ws("-", F.lit("all"), n)).when(n <= 9 + c % 5, F.concat_ws("-", F.lit("group"), group, n)).otherwise(F.concat_ws("-", F.lit("own"), c, n))
    events = facts.select("session_id", "conv_id", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("n")).select("session_id", n.alias("ordinal"), name.alias("hash"))
    return lineage.forks(events, facts.select("session_id", F.lit("m").alias("machine_id"), F.col("session_id").alias("external_id"), F.col("first_event_at").alias("started_at")))


@query("affected_sessions_fixpoint", "SELECT 's' || conv_id AS session_id FROM facts WHERE conv_id % 8 = 3")
def affected_sessions_fixpoint(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    first = facts.filter("conv_id = 3").select("session_id")
    by = facts.groupBy("workspace").agg(F.min("conv_id").alias("c")).select("workspace", F.concat(F.lit("s"), "c").alias("b"))
    return lineage.affected(first, facts.join(by, "workspace").select(F.col("session_id").alias("a"), "b"))


@query("session_facts", "SELECT session_id, event_count, user_message_count, duration_secs, input_tokens, primary_model FROM (SELECT f.session_id, f.event_count, (SELECT count(*) FROM items i WHERE i.session_id = f.session_id AND kind = 'user' AND tier = 'conversation') AS user_message_count, f.duration_secs, f.input_tokens, mode_.m AS primary_model FROM facts f LEFT JOIN (SELECT session_id, arg_min(model, (-n, model)) AS m FROM (SELECT session_id, model, count(*) AS n FROM items WHERE model IS NOT NULL GROUP BY 1, 2) GROUP BY 1) mode_ USING (session_id))")
def session_facts(spark, sf_dir):
    items, facts = model.items(spark, sf_dir), model.facts(spark, sf_dir)
    sessions = facts.select("session_id", "source_kind", "workspace", F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    return derive.session_facts(sessions, items, facts.select("session_id", "input_tokens", "cached_input_tokens", "output_tokens"), derive.models(items)).select("session_id", "event_count", "user_message_count", "duration_secs", "input_tokens", "primary_model")


@query("primary_model_mode", "SELECT session_id, arg_min(model, (-n, model)) AS primary_model, array_to_string(list(model ORDER BY model), ',') AS models FROM (SELECT session_id, model, count(*) AS n FROM items WHERE model IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def primary_model_mode(spark, sf_dir):
    return derive.models(model.items(spark, sf_dir)).select("session_id", "primary_model", F.array_join("models", ",").alias("models"))


@query("codex_max_vs_sum_tokens", """
WITH e AS (SELECT session_id, source_kind, ordinal, CASE WHEN source_kind = 'opencode' THEN (ordinal // 2)::VARCHAR ELSE ordinal::VARCHAR END AS k, CASE WHEN ordinal % 4 = 3 THEN 0 ELSE length(text) END AS n FROM items WHERE kind = 'assistant'),
o AS (SELECT session_id, source_kind, k, arg_min(n, ordinal) AS n FROM e GROUP BY 1, 2, 3)
SELECT session_id, (CASE WHEN any_value(source_kind) = 'codex' THEN max(n) ELSE sum(n) END)::BIGINT AS output_tokens FROM o GROUP BY 1
""")
def codex_max_vs_sum_tokens(spark, sf_dir):
    rows = model.items(spark, sf_dir).filter("kind = 'assistant'").select("session_id", "source_kind", "ordinal", F.floor(F.col("ordinal") / 2).cast("string").alias("message_id"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("cached_input_tokens"), F.when(F.col("ordinal") % 4 == 3, F.lit(-5)).otherwise(F.char_length("text")).cast("long").alias("output_tokens"))
    return derive.token_usage(rows).select("session_id", "output_tokens")


@query("history_items_tiers", """
SELECT item_id AS event_id, 0 AS subordinal, 'conversation' AS tier, kind FROM items WHERE kind IN ('user', 'assistant')
UNION ALL SELECT item_id, 10, 'tool', 'tool_call' FROM items WHERE ordinal % 5 = 4 AND ordinal % 2 = 0
UNION ALL SELECT item_id, 100, 'raw', kind FROM items WHERE NOT (ordinal % 7 = 6)
""")
def history_items_tiers(spark, sf_dir):
    o = F.col("ordinal")
    rows = model.items(spark, sf_dir).select(F.col("item_id").alias("event_id"), "kind", "text", (o % 7 == 6).alias("compacted"), F.when((o % 5 == 4) & (o % 2 == 0), F.array(F.struct(F.lit("tool_call").alias("kind"), F.lit("x").alias("text")))).alias("tools"))
    return derive.tiers(rows).select("event_id", "subordinal", "tier", "kind")


def _tool_events(spark, sf_dir):
    """A call and a result for each assistant turn: a commit by a shell tool, in two providers' shapes."""
    rows = model.items(spark, sf_dir).filter("kind = 'assistant'")
    sha = F.substring(F.md5("item_id"), 1, 8)
    call = F.to_json(F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), F.col("item_id").alias("call_id"), F.to_json(F.struct(F.concat(F.lit("cd /ws && git commit -m 'Change "), "item_id", F.lit("'")).alias("command"))).alias("arguments")))
    result = F.to_json(F.struct(F.lit("function_call_output").alias("type"), F.col("item_id").alias("call_id"), F.lit("completed").alias("status"), F.concat(F.lit("[main "), sha, F.lit("] Change "), "item_id", F.lit("\n 1 file changed")).alias("output")))
    return rows.select("session_id", F.explode(F.array(F.struct(F.concat("item_id", F.lit("c")).alias("event_id"), (F.col("ordinal") * 2).alias("ordinal"), call.alias("content")), F.struct(F.concat("item_id", F.lit("r")).alias("event_id"), (F.col("ordinal") * 2 + 1).alias("ordinal"), result.alias("content")))).alias("e")).select("session_id", "e.*")


@query("tool_signals", "SELECT signal, coalesce(status, 'none') AS status, count(*) AS n FROM (SELECT unnest([{'signal': 'call', 'status': NULL}, {'signal': 'result', 'status': 'success'}], recursive := true) FROM items WHERE kind = 'assistant') GROUP BY 1, 2")
def tool_signals(spark, sf_dir):
    return tools.normalise(_tool_events(spark, sf_dir)).groupBy("signal", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query("tool_pairs", "SELECT session_id, item_id AS call_id, item_id || 'c' AS event_id, item_id || 'r' AS result_event_id, 'success' AS status FROM items WHERE kind = 'assistant'")
def tool_pairs(spark, sf_dir):
    return tools.pairs(tools.normalise(_tool_events(spark, sf_dir))).select("session_id", "call_id", "event_id", "result_event_id", "status")


@query("commit_evidence", "SELECT session_id, left(md5(item_id), 8) AS sha, 'change ' || item_id AS normalized_message, '/ws' AS cwd FROM items WHERE kind = 'assistant'")
def commit_evidence(spark, sf_dir):
    return tools.commits(tools.pairs(tools.normalise(_tool_events(spark, sf_dir)))).select("session_id", "sha", "normalized_message", "cwd")


@query("blame_strength_rank", "SELECT item_id AS line_item, CASE WHEN ordinal % 2 = 1 THEN 'sha_prefix' ELSE 'message' END AS strength FROM items WHERE kind = 'assistant' AND ordinal % 4 < 2")
def blame_strength_rank(spark, sf_dir):
    rows = model.items(spark, sf_dir).filter("kind = 'assistant'")
    evidence = rows.select("session_id", F.col("item_id").alias("event_id"), F.substring(F.md5("item_id"), 1, 12).alias("sha"), F.concat(F.lit("z"), F.md5("item_id")).alias("normalized_message"), F.lit("/ws").alias("cwd"))
    odd = F.col("ordinal") % 2 == 1
    commits = rows.filter("ordinal % 4 < 2").select(F.concat(F.when(odd, F.md5("item_id")).otherwise(F.repeat(F.lit("f"), 32)), F.lpad("conv_id", 8, "0")).alias("sha"), F.when(odd, "qq").otherwise(F.concat(F.lit("Z"), F.md5("item_id"))).alias("message"), "item_id")
    found = blame.candidates(commits.select("sha", "message"), evidence)
    return found.join(commits, "sha").filter("event_id = item_id").select(F.col("item_id").alias("line_item"), "strength")


@query("blame_sessions", """
WITH l AS (SELECT 's' || left(md5(conv_id::VARCHAR), 1) AS session_id, conv_id * 10 + turn AS line FROM conversations),
r AS (SELECT session_id, line, line - row_number() OVER (PARTITION BY session_id ORDER BY line) AS run FROM (SELECT DISTINCT * FROM l)),
i AS (SELECT session_id, min(line) AS first, max(line) AS last FROM r GROUP BY session_id, run)
SELECT session_id, 'exact_sha' AS strength, (SELECT count(DISTINCT line) FROM l WHERE l.session_id = i.session_id) AS lines, string_agg(first || '-' || last, ',' ORDER BY first) AS ranges FROM i GROUP BY 1
""")
def blame_sessions(spark, sf_dir):
    lines = cluster.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("line"), F.md5(F.col("conv_id").cast("string")).alias("sha"))
    found = lines.select("sha").distinct().withColumn("session_id", F.concat(F.lit("s"), F.substring("sha", 1, 1))).withColumn("rank", F.lit(1))
    return blame.by_session(blame.classify(lines, found)).select("session_id", "strength", "lines", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first"], r["last"])), ",").alias("ranges"))


@query("skill_usage_rollup", """
WITH o AS (SELECT 'k' || (conv_id % 5) AS k, * FROM items),
e AS (SELECT k, item_id, row_number() OVER (PARTITION BY k ORDER BY occurred_at DESC, item_id DESC) AS n FROM o)
SELECT 'local:skills/' || k || '/SKILL.md' AS locator, count(DISTINCT session_id) AS sessions, count(*) AS loads, min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(DISTINCT text_hash) AS versions, count(*) AS complete, k AS names,
  (SELECT string_agg(item_id, ',' ORDER BY n) FROM e WHERE e.k = o.k AND n <= 5) AS evidence FROM o GROUP BY k
""")
def skill_usage_rollup(spark, sf_dir):
    rows = model.items(spark, sf_dir).select("session_id", F.col("item_id").alias("event_id"), F.concat(F.lit("local:skills/k"), F.col("conv_id") % 5, F.lit("/SKILL.md")).alias("locator"), F.concat(F.lit("k"), F.col("conv_id") % 5).alias("skill_name"), F.col("occurred_at").alias("observed_at"), F.col("text_hash").alias("content_hash"), F.lit("complete").alias("coverage"))
    return tools.skill_usage(rows).withColumn("names", F.array_join("names", ",")).withColumn("evidence", F.array_join("evidence", ","))


@query("status_count_deltas", "SELECT source_kind, count(*) AS sessions FROM facts WHERE conv_id % 10 <> 0 GROUP BY 1")
def status_count_deltas(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    gone = facts.filter("conv_id % 10 = 0").groupBy("source_kind").agg((-F.count("*")).alias("sessions"))
    return maintenance.count_deltas(facts.groupBy("source_kind").agg(F.count("*").alias("sessions")), gone)


@query("first_class_signal", "SELECT session_id, coalesce(CASE WHEN has THEN lead ELSE any_ END, 'interactive') AS signal FROM (SELECT session_id, arg_min(s, ordinal) FILTER (s IS NOT NULL AND kind = 'system') AS lead, bool_or(kind = 'system') AS has, arg_min(s, ordinal) FILTER (s IS NOT NULL) AS any_ FROM (SELECT *, CASE WHEN ordinal % 3 = 1 THEN 'k' || (conv_id % 4) || kind END AS s FROM items) GROUP BY 1)")
def first_class_signal(spark, sf_dir):
    from sessionlake.operators import sequences

    rows = model.items(spark, sf_dir).withColumn("signal", F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit("k"), F.col("conv_id") % 4, "kind")))
    return sequences.first_signal(rows, "session_id", "ordinal", "kind", "signal", "system", "interactive")


@query("search_segments", "SELECT item_id AS event_id, CASE WHEN kind IN ('user', 'assistant') THEN kind END AS kind, CASE WHEN kind IN ('user', 'assistant') THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text FROM items WHERE trim(text) <> ''")
def search_segments(spark, sf_dir):
    rows = model.items(spark, sf_dir).filter("trim(text) <> ''")
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    line = F.to_json(F.struct(F.struct(F.col("kind").alias("role"), F.array(part("tool_use", F.lit("no")), part("text", F.col("text"))).alias("content")).alias("message")))
    return derive.segments(rows.select(F.col("item_id").alias("event_id"), line.alias("line"))).select("event_id", "kind", "text")


@query("agent_path_walk", "SELECT item_id AS event_id, 'a' || conv_id AS value FROM items WHERE ordinal % 2 = 0")
def agent_path_walk(spark, sf_dir):
    line = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit('{"x": [{"y": {"agent_path": "a'), "conv_id", F.lit('"}}]}'))).otherwise("no JSON")
    return derive.walk(model.items(spark, sf_dir).select(F.col("item_id").alias("event_id"), line.alias("line")), "agent_path")


@query("topic_shares", "SELECT label AS topic_id, count(*) AS messages, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM embeddings GROUP BY 1")
def topic_shares(spark, sf_dir):
    from sessionlake.operators import topics

    return topics.share(cluster.table(spark, sf_dir, "embeddings").select(F.col("label").alias("topic_id"))).withColumn("share", F.round("share", 9))


@query("event_windows_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_windows_tumbling(spark, sf_dir):
    from sessionlake.streaming import incremental

    return incremental.activity_windows(cluster.table(spark, sf_dir, "events")).select("start", "event_type", "events")
