"""Look-ups, lineage, JSON, logs and incremental maintenance."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.functions import dates, ids, text
from sessionlake.operators import annotate, blame, derive, filters, lineage, lookups, maintenance, search, sequences, tools, topics, transcript
from sessionlake.plans import model
from sessionlake.plans.catalog import query
from sessionlake.sources import archive, transcripts
from sessionlake.streaming import incremental


def _scratch(spark, name: str) -> str:
    return f"{cluster.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sessions(spark, sf_dir):
    facts = model.facts(spark, sf_dir)
    return facts.withColumn("machine_id", F.concat(F.lit("m"), F.col("conv_id") % 3)).withColumn("external_id", F.concat(F.lit("x"), F.floor(F.col("conv_id") / 2).cast("long"))).withColumn("path", F.concat(F.lit("/logs/"), F.col("conv_id") % 5)).withColumn("source_id", F.col("source_kind"))


# scalar functions


@query("glob_filter", "SELECT item_id FROM items WHERE regexp_matches(item_id, '^i1.*-[0-3]$') OR regexp_matches(item_id, '^i.-[^0-2]$')")
def glob_filter(spark, sf_dir):
    c = F.col("item_id")
    return model.items(spark, sf_dir).filter(filters.glob(c, "i1*-[0-3]") | filters.glob(c, "i?-[^0-2]")).select("item_id")


@query("paths_cleaned", "SELECT item_id, CASE WHEN ordinal % 2 = 0 THEN '/ws/p' || (conv_id % 8) || '/x' ELSE 'a/' || ordinal END AS path FROM items")
def paths_cleaned(spark, sf_dir):
    raw = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("/../ws/./old/../p"), F.col("conv_id") % 8, F.lit("//x/"))).otherwise(F.concat(F.lit("../a/b/../"), "ordinal", F.lit("/.")))
    return model.items(spark, sf_dir).select("item_id", text.clean_path(raw).alias("path"))


@query("names_checked", "SELECT item_id, ordinal % 3 = 0 AS uuid, ordinal % 3 <> 2 AS hex FROM items")
def names_checked(spark, sf_dir):
    h = F.md5("item_id")
    dashed = F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    o = F.col("ordinal") % 3
    return model.items(spark, sf_dir).select("item_id", text.is_uuid(F.when(o == 0, dashed).otherwise(h)).alias("uuid"), text.is_hex(F.when(o == 2, F.concat(h, F.lit("g"))).otherwise(h), 4).alias("hex"))


@query("git_remotes", "SELECT item_id, 'https://h.org/o/r' || conv_id AS remote FROM items")
def git_remotes(spark, sf_dir):
    c = F.col("conv_id")
    shapes = [F.concat(F.lit("git@h.org:o/r"), c, F.lit(".git")), F.concat(F.lit("ssh://git@h.org/o/r"), c, F.lit("/")), F.concat(F.lit(" https://user@h.org/o/r"), c)]
    return model.items(spark, sf_dir).select("item_id", text.https_remote(F.element_at(F.array(*shapes), (F.col("ordinal") % 3 + 1).cast("int"))).alias("remote"))


@query("tool_outputs", "SELECT item_id, 'a' || ordinal || chr(10) || 'b' AS body, ordinal % 2 = 0 AS cut, 'skill ' || conv_id AS name FROM items")
def tool_outputs(spark, sf_dir):
    numbered = F.concat(F.lit("  1→a"), "ordinal", F.lit("\n  2→b"))
    marked = F.when(F.col("ordinal") % 2 == 0, "x\n[Output truncated here]").otherwise("x [lines omitted] y")
    front = F.concat(F.lit('---\nkind: k\nname: "skill '), "conv_id", F.lit('"\n---\nbody'))
    return model.items(spark, sf_dir).select("item_id", text.unnumbered(numbered).alias("body"), text.truncated(marked).alias("cut"), text.frontmatter_name(front).alias("name"))


@query("wrappers_stripped", "SELECT item_id, CASE ordinal % 3 WHEN 0 THEN 'look ' || conv_id WHEN 1 THEN 'args ' || conv_id ELSE '<b> ' || conv_id END AS said FROM items")
def wrappers_stripped(spark, sf_dir):
    o, c = F.col("ordinal") % 3, F.col("conv_id")
    raw = F.when(o == 0, F.concat(F.lit("<image name=a> look "), c)).when(o == 1, F.concat(F.lit("<command-name>go</command-name> args "), c)).otherwise(F.concat(F.lit("<b> "), c))
    rule = F.when(o == 0, "tag.image").when(o == 1, "tag.command_name").otherwise("default.human")
    return model.items(spark, sf_dir).select("item_id", derive.human_text(raw, rule).alias("said"))


@query("session_titles", "SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN 'native ' || conv_id WHEN conv_id % 3 = 1 THEN 'inline ' || conv_id ELSE left('first line of ' || conv_id || repeat('x', 120), 100) END AS title FROM facts")
def session_titles(spark, sf_dir):
    c = F.col("conv_id")
    lines = F.array(F.lit("# AGENTS.md read this"), F.lit("<context>"), F.concat(F.lit(" first line of "), c, F.repeat(F.lit("x"), 120), F.lit("\nmore")))
    return model.facts(spark, sf_dir).select("session_id", derive.title(F.when(c % 3 == 0, F.concat(F.lit(" native "), c)).otherwise(" "), F.when(c % 3 == 1, F.concat(F.lit("inline "), c)), lines).alias("title"))


@query("zone_days", "SELECT item_id, date_trunc('day', occurred_at + INTERVAL 3 HOUR) - INTERVAL 3 HOUR AS day_start, date_trunc('day', occurred_at + INTERVAL 3 HOUR) + INTERVAL 21 HOUR AS day_end FROM items")
def zone_days(spark, sf_dir):
    return model.items(spark, sf_dir).select("item_id", dates.day_bounds(F.col("occurred_at"), "Etc/GMT-3").alias("d")).select("item_id", F.col("d.start").alias("day_start"), F.col("d.end").alias("day_end"))


@query("name_filter", "SELECT session_id FROM facts WHERE contains(lower(workspace), 'p3') OR contains(lower(primary_model), 'el-1')")
def name_filter(spark, sf_dir):
    return model.facts(spark, sf_dir).filter(filters.contains_any_case("P3", F.col("workspace")) | filters.contains_any_case("EL-1", F.col("primary_model"))).select("session_id")


# JSON


_DOC = """'{"n":' || ordinal || ',"m":{"kind":"' || kind || '","k":1.5},"l":[1,true]}'"""
_PATCH = """CASE ordinal % 4 WHEN 0 THEN '{"n":null,"m":{"kind":null,"x":[1,{"y":null}]}}' WHEN 1 THEN '{"m":5}' WHEN 2 THEN '{"l":{"a":"b"},"z":false}' END"""


@query("json_merge_patch", f"SELECT item_id, d ->> '$.n' AS n, d ->> '$.m.kind' AS kind, d ->> '$.m.k' AS k, d ->> '$.m.x[0]' AS x, CASE WHEN ordinal % 4 = 1 THEN d ->> '$.m' END AS m, d ->> '$.l[1]' AS l, d ->> '$.l.a' AS a, d ->> '$.z' AS z FROM (SELECT *, CASE WHEN p IS NULL THEN o::JSON ELSE json_merge_patch(o, p) END AS d FROM (SELECT *, {_DOC} AS o, {_PATCH} AS p FROM items))")
def json_merge_patch(spark, sf_dir):
    rows = model.items(spark, sf_dir).select("item_id", "ordinal", maintenance.merged_json(F.expr(_DOC), F.expr(_PATCH)).alias("d"))
    at = lambda p: F.get_json_object("d", p)
    return rows.select("item_id", at("$.n").alias("n"), at("$.m.kind").alias("kind"), at("$.m.k").alias("k"), at("$.m.x[0]").alias("x"), F.when(F.col("ordinal") % 4 == 1, at("$.m")).alias("m"), at("$.l[1]").alias("l"), at("$.l.a").alias("a"), at("$.z").alias("z"))


@query("metadata_refreshed", "SELECT item_id AS event_id FROM items WHERE ordinal % 3 = 0 AND conv_id % 2 = 0")
def metadata_refreshed(spark, sf_dir):
    events = model.items(spark, sf_dir).select(F.col("item_id").alias("event_id"), F.col("text_hash").alias("hash"), "ordinal", "conv_id", F.lit('{"a":1}').alias("metadata_json"))
    patches = events.filter("conv_id % 2 = 0").select("event_id", F.when(F.col("ordinal") % 3 != 2, F.col("hash")).otherwise("other").alias("hash"), F.when(F.col("ordinal") % 3 == 1, '{"a":1}').otherwise('{"b":{"c":2}}').alias("metadata_json"))
    return maintenance.refreshed(events, patches)[1]


@query("usage_merged", "SELECT item_id, 'part' AS kept, CASE WHEN conv_id % 2 = 0 THEN length(text) END AS output FROM items")
def usage_merged(spark, sf_dir):
    rows = model.items(spark, sf_dir)
    items = rows.select("item_id", F.col("item_id").alias("message_id"), F.lit("p").alias("part_id"), F.lit('{"kept": "part", "usage": {"input": 1}}').alias("metadata_json"))
    usage = rows.filter("conv_id % 2 = 0").select(F.col("item_id").alias("message_id"), F.lit("p").alias("part_id"), F.to_json(F.struct(F.struct(F.char_length("text").alias("output")).alias("usage"))).alias("usage"))
    out = derive.usage_backfill(items, usage)
    counted = derive.json_count(F.col("metadata_json"), "$.usage.output")
    return out.select("item_id", F.get_json_object("metadata_json", "$.kept").alias("kept"), F.when(F.get_json_object("metadata_json", "$.usage.output").isNotNull(), counted).alias("output"))


_ONE_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _odd_lines(spark, sf_dir):
    """Lines of several shapes; in each only the text of the item was said."""
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    leaks = [F.struct(F.lit("leak").alias("text"), F.lit("x").alias("stdout")), F.struct(F.lit("leak").alias("text"), F.lit("y").alias("tool_use_id")), F.struct(F.lit("Bash").alias("name"), F.lit("leak").alias("text")), F.struct(F.lit("thinking_delta").alias("type"), F.lit("leak").alias("text"))]
    objects = [F.concat(F.lit('{"message":{"role":"'), "kind", F.lit('","content":['), F.to_json(leak), F.lit(","), F.to_json(said), F.lit("]}}")) for leak in leaks]
    return model.items(spark, sf_dir).select(F.col("item_id").alias("event_id"), "kind", "ordinal", F.element_at(F.array(*objects), (F.col("ordinal") % len(objects) + 1).cast("int")).alias("line"))


@query("segments_without_tools", f"SELECT item_id AS event_id, CASE WHEN kind <> 'system' THEN {_ONE_LINE} END AS text, CASE WHEN kind = 'system' THEN 'instruction event' END AS skipped FROM items WHERE trim(text) <> ''")
def segments_without_tools(spark, sf_dir):
    wanted = model.items(spark, sf_dir).filter("trim(text) <> ''").select(F.col("item_id").alias("event_id"))
    return derive.segments(_odd_lines(spark, sf_dir).join(wanted, "event_id", "left_semi")).select("event_id", "text", "skipped")


# logs


def _logs(spark, sf_dir, folder: str) -> str:
    """Sixteen log files, a line for each turn of some conversations, in order."""
    path = _scratch(spark, folder)
    line = F.to_json(F.struct("conv_id", F.col("kind").alias("role"), F.col("text").alias("content"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(F.col("ordinal") == 0, F.concat(F.lit("/ws/p"), F.col("conv_id") % 16)).alias("cwd")))
    model.items(spark, sf_dir).withColumn("log", (F.col("conv_id") % 16).cast("int")).select("log", "conv_id", "ordinal", line.alias("value")).repartition(16, "log").sortWithinPartitions("log", "conv_id", "ordinal").select("log", "value").write.partitionBy("log").text(path)
    return path


@query("log_events", f"SELECT conv_id % 16 AS log, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, ordinal) - 1 AS ordinal, kind AS role, CASE WHEN kind IN ('user', 'assistant') THEN {_ONE_LINE} END AS said, occurred_at FROM items WHERE trim(text) <> ''")
def log_events(spark, sf_dir):
    found = transcripts.events(transcripts.lines(spark, [_logs(spark, sf_dir, "logs")], "*.txt"), "codex")
    return found.filter(F.trim(F.get_json_object("line", "$.content")) != "").select(F.regexp_extract("path", r"log=(\d+)", 1).cast("long").alias("log"), "ordinal", "role", F.when(F.col("role").isin("user", "assistant"), F.col("content")).alias("said"), "occurred_at")


@query("log_sessions", "SELECT conv_id % 16 AS log, count(*) AS event_count, arg_min(occurred_at, (conv_id, ordinal)) AS started_at, arg_max(occurred_at, (conv_id, ordinal)) AS updated_at, '/ws/p' || (conv_id % 16) AS workspace FROM items GROUP BY conv_id % 16")
def log_sessions(spark, sf_dir):
    found = transcripts.sessions(transcripts.events(transcripts.lines(spark, [_logs(spark, sf_dir, "logs")], "*.txt"), "codex"))
    return found.select(F.regexp_extract("path", r"log=(\d+)", 1).cast("long").alias("log"), "event_count", "started_at", "updated_at", "workspace")


@query("workspaces_found", "SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN '/home/u/w' || conv_id WHEN conv_id % 3 = 1 THEN '/ws/p' || (conv_id % 8) || '/sub' ELSE '/srv/app' || conv_id END AS workspace_path, CASE WHEN conv_id % 3 = 0 THEN '/home/u/w' || conv_id WHEN conv_id % 3 = 1 THEN '/ws/p' || (conv_id % 8) ELSE '/srv/app' || conv_id END AS workspace_root, CASE WHEN conv_id % 3 = 2 THEN 'inferred' ELSE 'observed' END AS confidence FROM facts")
def workspaces_found(spark, sf_dir):
    c = F.col("conv_id")
    named = F.when(c % 3 == 0, F.concat(F.lit("~/x/../w"), c)).when(c % 3 == 1, F.concat(F.lit(" /ws/p"), c % 8, F.lit("/sub/")))
    found = model.facts(spark, sf_dir).select("session_id", F.lit("claude_code").alias("source_kind"), F.concat(F.lit("/logs/-srv-app"), c, F.lit("/a.jsonl")).alias("path"), F.lit(0).cast("long").alias("ordinal"), named.alias("workspace"), F.lit(None).cast("string").alias("git_branch"), F.lit(None).cast("string").alias("git_repository"))
    roots = spark.range(8).select(F.concat(F.lit("/ws/p"), "id").alias("root")).union(spark.createDataFrame([("/ws",)], "root string"))
    return transcripts.workspaces(found, "/home/u/", roots).select("session_id", "workspace_path", "workspace_root", "confidence")


@query("omp_names", "SELECT conv_id, 'l' || conv_id // 3 || CASE WHEN conv_id % 3 > 0 THEN '/c1' ELSE '' END || CASE WHEN conv_id % 3 = 2 THEN '/c2' ELSE '' END AS external_id, CASE conv_id % 3 WHEN 0 THEN 'fork' ELSE 'subagent' END AS relationship FROM facts")
def omp_names(spark, sf_dir):
    c = F.col("conv_id")
    top = F.concat(F.lit("/r/l"), F.floor(c / 3).cast("long"))
    every = model.facts(spark, sf_dir).select(F.explode(F.sequence(F.floor(c / 3).cast("long") * 3, F.floor(c / 3).cast("long") * 3 + 2)).alias("conv_id")).distinct()
    logs = every.select("conv_id", F.concat(top, F.when(c % 3 > 0, "/c1").otherwise(""), F.when(c % 3 == 2, "/c2").otherwise(""), F.lit(".jsonl")).alias("path"), F.lit("/old/parent.jsonl").alias("parent_session"))
    own = model.facts(spark, sf_dir).select("conv_id")
    return lineage.omp_identity(logs).join(logs.select("path", "conv_id"), "path").join(own, "conv_id", "left_semi").select("conv_id", "external_id", "relationship")


# lineage


@query("lineage_hints", "SELECT session_id, CASE conv_id % 4 WHEN 1 THEN '00000000-0000-0000-0000-' || lpad(conv_id::VARCHAR, 12, '0') WHEN 2 THEN 's' || (conv_id // 2) WHEN 3 THEN 't' || conv_id END AS parent_external_id, CASE conv_id % 4 WHEN 1 THEN 'claude.subagent_path' WHEN 2 THEN 'opencode.parent_id' WHEN 3 THEN 'omp.parent_session' ELSE 'default.none' END AS rule FROM facts")
def lineage_hints(spark, sf_dir):
    c = F.col("conv_id")
    meta = F.when(c % 4 == 1, F.to_json(F.struct(F.concat(F.lit("/p/00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"), F.lit("/subagents/agent-7.jsonl")).alias("path")))).when(c % 4 == 2, F.to_json(F.struct(F.concat(F.lit("s"), F.floor(c / 2).cast("long")).alias("opencode_parent_id")))).when(c % 4 == 3, F.to_json(F.struct(F.concat(F.lit("t"), c).alias("omp_parent_external_id"), F.lit("fork").alias("omp_relationship"))))
    return model.facts(spark, sf_dir).select("session_id", lineage.hint(F.col("source_kind"), meta).alias("h")).select("session_id", "h.parent_external_id", "h.rule")


@query("notified_children", "SELECT c.session_id, min(p.session_id) AS parent_session_id, CASE WHEN count(DISTINCT p.session_id) > 1 THEN 'notification.collision' ELSE 'notification' END AS rule FROM facts c JOIN facts p ON p.conv_id = c.conv_id - 3 OR (p.conv_id = c.conv_id - 6 AND c.conv_id % 2 = 0) GROUP BY 1")
def notified_children(spark, sf_dir):
    sessions = _sessions(spark, sf_dir).withColumn("external_id", F.col("session_id"))
    c = F.col("conv_id")
    after = F.array(F.struct((c + 3).alias("child"), F.lit(1).alias("ordinal")), F.struct(F.when((c + 6) % 2 == 0, c + 6).alias("child"), F.lit(2).alias("ordinal")))
    mentions = sessions.select("session_id", "machine_id", F.explode(after).alias("m")).filter("m.child is not null").select("session_id", "machine_id", F.concat(F.lit("s"), "m.child").alias("agent_path"), F.col("m.ordinal").alias("ordinal"))
    return lineage.notified(mentions, sessions)


def _inline(spark, sf_dir):
    """Turns as a chain; from turn 2 on they are a sidechain, and turn 0 of every other session used the Task tool."""
    rows = model.items(spark, sf_dir)
    o = F.col("ordinal")
    return rows.select("session_id", F.col("item_id").alias("event_id"), F.concat(F.lit("u"), o).alias("uuid"), F.when(o > 0, F.concat(F.lit("u"), o - 1)).alias("parent_uuid"), (o >= 2).alias("sidechain"), ((o == 0) & (F.col("conv_id") % 2 == 0)).alias("task_tool_use"))


@query("sidechain_overrides", "SELECT item_id AS event_id, 'sc_' || sha256('session_relationship' || chr(0) || 'inline' || chr(0) || session_id || chr(0) || session_id || '/u2' || chr(0)) AS session_id FROM items i WHERE ordinal >= 2 AND (SELECT count(*) FROM items j WHERE j.session_id = i.session_id AND j.ordinal <= i.ordinal) = i.ordinal + 1")
def sidechain_overrides(spark, sf_dir):
    whole = _whole_chains(spark, sf_dir)
    return lineage.sidechains(_inline(spark, sf_dir).join(whole, "event_id", "left_semi"))[0]


def _whole_chains(spark, sf_dir):
    """Items with no gap before them in their session."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("session_id").orderBy("ordinal"))
    return model.items(spark, sf_dir).withColumn("n", n).filter("n = ordinal + 1").select(F.col("item_id").alias("event_id"))


@query("sidechain_parents", "SELECT CASE WHEN conv_id % 2 = 0 THEN session_id END AS parent_session_id, CASE WHEN conv_id % 2 = 0 THEN 'claude.inline_sidechain' ELSE 'claude.inline_orphan' END AS rule, count(*) AS n FROM (SELECT DISTINCT conv_id, session_id FROM items i WHERE ordinal = 2 AND (SELECT count(*) FROM items j WHERE j.session_id = i.session_id AND j.ordinal <= 2) = 3) GROUP BY 1, 2")
def sidechain_parents(spark, sf_dir):
    relations = lineage.sidechains(_inline(spark, sf_dir).join(_whole_chains(spark, sf_dir), "event_id", "left_semi"))[1]
    return relations.groupBy("parent_session_id", "rule").agg(F.count("*").alias("n"))


@query("effective_sessions", "SELECT item_id, CASE WHEN ordinal % 4 = 3 THEN 'moved' || conv_id ELSE session_id END AS effective_session_id, CASE WHEN ordinal % 4 = 3 THEN 'subagent' WHEN conv_id % 5 = 0 AND ordinal % 4 <> 1 THEN 'subagent' ELSE 'none' END AS relationship FROM items")
def effective_sessions(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("event_id", F.col("item_id"))
    moved = rows.filter("ordinal % 4 = 3").select("event_id", F.concat(F.lit("moved"), "conv_id").alias("session_id"))
    relations = rows.filter("conv_id % 5 = 0").select("session_id").distinct().union(moved.select("session_id").distinct()).withColumn("relationship", F.lit("subagent"))
    taken = rows.select("item_id", (F.col("ordinal") % 4 == 1).alias("inherited"))
    return lineage.effective(rows, moved, relations, taken).select("item_id", "effective_session_id", "relationship")


_RELATED = "CASE WHEN conv_id % 5 = 0 AND conv_id > 0 THEN 's' || (conv_id // 2) END"


@query("inherited_in_scope", f"WITH r AS (SELECT session_id, conv_id, {_RELATED} AS parent FROM facts), i AS (SELECT item_id, session_id, kind, ordinal % 3 AS h FROM items) SELECT i.item_id, EXISTS (SELECT 1 FROM i p WHERE p.session_id = r.parent AND p.kind = i.kind AND p.h = i.h) AS inherited FROM i JOIN r USING (session_id) WHERE parent IS NOT NULL AND (session_id IN ('s5', 's10') OR parent IN ('s5', 's10'))")
def inherited_in_scope(spark, sf_dir):
    c = F.col("conv_id")
    relations = model.facts(spark, sf_dir).filter("conv_id % 5 = 0 and conv_id > 0").select("session_id", F.concat(F.lit("s"), F.floor(c / 2).cast("long")).alias("parent_session_id"), F.lit("subagent").alias("relationship"))
    rows = model.items(spark, sf_dir).withColumn("text_hash", F.col("ordinal") % 3)
    return lineage.scoped_inherited(rows, relations, spark.createDataFrame([("s10",), ("s5",)], "session_id string")).filter("item_id is not null")


# look-ups


@query("lookup_external_id", "SELECT session_id FROM facts WHERE conv_id // 2 = 3")
def lookup_external_id(spark, sf_dir):
    return lookups.by_external_id(_sessions(spark, sf_dir), "x3").select("session_id")


@query("latest_external_ids", "SELECT '/logs/' || conv_id % 5 AS path, 'x' || arg_max(conv_id, (last_event_at, session_id)) // 2 AS external_id FROM facts GROUP BY conv_id % 5")
def latest_external_ids(spark, sf_dir):
    rows = _sessions(spark, sf_dir).withColumn("updated_at", F.col("last_event_at")).withColumn("started_at", F.col("first_event_at"))
    return lookups.latest_external_id(rows)


@query("lookup_items_of_event", "SELECT item_id FROM items WHERE session_id = 's2' AND ordinal = 1")
def lookup_items_of_event(spark, sf_dir):
    return lookups.by_id(model.items(spark, sf_dir).withColumn("event_id", F.concat_ws("/", "session_id", "ordinal")), "event_id", "s2/1").select("item_id")


@query("foreign_sources", "SELECT DISTINCT source_kind AS source_id FROM facts WHERE conv_id % 3 <> 0")
def foreign_sources(spark, sf_dir):
    return lookups.foreign_sources(_sessions(spark, sf_dir), "m0")


@query("blobs_missing", "SELECT DISTINCT md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def blobs_missing(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    return maintenance.missing_blobs(rows, rows.filter("doc_id % 3 = 0").select("hash").distinct())


@query("blobs_verified", "SELECT 'sha256:' || sha256(text) AS hash FROM documents WHERE doc_id % 4 = 0")
def blobs_verified(spark, sf_dir):
    docs = cluster.table(spark, sf_dir, "documents")
    data = F.encode("text", "UTF-8")
    artifacts = docs.filter("doc_id % 4 <> 3").select(ids.content_hash(data).alias("hash"))
    lone = docs.select("doc_id", ids.content_hash(data).alias("hash"), F.when(F.col("doc_id") % 4 == 1, 0).otherwise(F.octet_length("text")).cast("long").alias("size"), F.base64(F.when(F.col("doc_id") % 4 == 2, F.encode(F.concat("text", F.lit("x")), "UTF-8")).otherwise(data)).alias("content"))
    sound, _ = maintenance.verified_blobs(lone.filter("doc_id % 4 <> 3").drop("doc_id"), artifacts)
    return sound.select("hash")


@query("blobs_stored", "SELECT 'sha256:' || sha256(text) AS hash, any_value(strlen(text)) AS size FROM documents GROUP BY 1 HAVING min(doc_id % 2) = 1")
def blobs_stored(spark, sf_dir):
    store = _scratch(spark, "blob-store")
    rows = cluster.table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.encode("text", "UTF-8")).alias("hash"), F.encode("text", "UTF-8").alias("content"))
    maintenance.store_blobs(rows.filter("doc_id % 2 = 0").select("hash", "content"), store)
    return maintenance.store_blobs(rows.select("hash", "content"), store)


@query("queue_page", "SELECT item_id FROM items WHERE tier = 'conversation' AND length(trim(text)) >= 80 AND (occurred_at > TIMESTAMP '2024-01-01 03:01:00' OR (occurred_at = TIMESTAMP '2024-01-01 03:01:00' AND item_id > 'i3-1')) ORDER BY occurred_at, session_id, ordinal, item_id LIMIT 40")
def queue_page(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("semantic_policy", F.lit("required")).withColumn("subordinal", F.lit(0))
    none = spark.createDataFrame([], "unit_id string, text_hash string, model_id string")
    after = {"occurred_at_key": "2024-01-01 03:01:00", "session_id": "s3", "ordinal": 1, "subordinal": 0, "item_id": "i3-1"}
    return maintenance.work_queue(rows, none, "m", 40, after).select("item_id")


@query("sizes_previewed", 'SELECT \'documents\' AS "table", count(*) AS rows, sum(strlen(text))::BIGINT AS bytes FROM documents UNION ALL SELECT \'pages\', count(*), sum(strlen(html))::BIGINT FROM pages')
def sizes_previewed(spark, sf_dir):
    return maintenance.size_preview({n: cluster.table(spark, sf_dir, n) for n in ("documents", "pages")}, {"documents": "text", "pages": "html"})


@query("archive_cleaned", "SELECT item_id, NULL::VARCHAR AS raw_artifact_hash, 0::BIGINT AS left_over FROM items")
def archive_cleaned(spark, sf_dir):
    rows = model.items(spark, sf_dir).withColumn("raw_artifact_hash", F.col("text_hash"))
    events, tables = maintenance.archive_cleanup(rows, {"raw_artifacts": rows})
    return events.select("item_id", "raw_artifact_hash").crossJoin(F.broadcast(tables["raw_artifacts"].agg(F.count("*").alias("left_over"))))


@query("vectors_to_refresh", "SELECT item_id, CASE WHEN conv_id % 3 = 0 THEN 'add' ELSE 'remove' END AS change FROM items WHERE (conv_id % 3 = 0 AND tier <> 'raw') OR (conv_id % 3 = 1 AND (tier = 'raw' OR ordinal % 2 = 1))")
def vectors_to_refresh(spark, sf_dir):
    items = model.items(spark, sf_dir).withColumn("semantic_policy", F.when(F.col("tier") == "raw", "never").otherwise("required"))
    vector = F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    embeddings = items.filter("conv_id % 3 = 0").select(F.col("item_id").alias("unit_id"), "text_hash", F.lit("m").alias("model_id"), F.lit(2).alias("dims"), vector.alias("vector"))
    held = items.filter("conv_id % 3 = 1").select("item_id", F.when(F.col("ordinal") % 2 == 1, "old").otherwise(F.col("text_hash")).alias("text_hash"), vector.alias("embedding"))
    add, gone = search.refreshed_vectors(held, embeddings, items, "m", 2)
    return add.select("item_id", F.lit("add").alias("change")).union(gone.select("item_id", F.lit("remove")))


@query("index_healthy", "SELECT count(*) AS units, count(*) FILTER (conv_id % 7 <> 0) AS indexed, count(*) AS indexable, count(*) FILTER (conv_id % 7 = 0) = 0 AS sound FROM items")
def index_healthy(spark, sf_dir):
    rows = model.items(spark, sf_dir)
    return lookups.index_health(rows, rows.filter("conv_id % 7 <> 0"), rows)


@query("topics_unlabeled", "SELECT DISTINCT label AS topic_id FROM embeddings WHERE label % 3 <> 0")
def topics_unlabeled(spark, sf_dir):
    every = cluster.table(spark, sf_dir, "embeddings").select(F.lit("v1").alias("version"), F.col("label").alias("topic_id")).distinct()
    return lookups.unlabeled(every, every.filter("topic_id % 3 = 0").withColumn("labeler_version", F.lit("l1")), "l1").select("topic_id")


def _topic_items(spark, sf_dir):
    rows = model.items(spark, sf_dir)
    return rows.select("item_id", (F.col("ordinal") % 4).alias("topic_id")), rows


@query("topics_by_month", "SELECT ordinal % 4 AS topic_id, strftime(occurred_at, '%Y-%m') AS month, count(*) AS messages FROM items GROUP BY 1, 2")
def topics_by_month(spark, sf_dir):
    return topics.by_month(*_topic_items(spark, sf_dir))


@query("topics_by_project", "SELECT workspace, ordinal % 4 AS topic_id, count(*) AS messages FROM items GROUP BY 1, 2")
def topics_by_project(spark, sf_dir):
    return topics.by_project(*_topic_items(spark, sf_dir))


@query("topic_nearest", """
WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT vec_id, c.label AS topic_id, list_distance(embedding::DOUBLE[], centre) AS d FROM embeddings, c)
SELECT vec_id AS item_id, arg_min(topic_id, (d, topic_id)) AS topic_id, round(min(d), 6) AS distance FROM d GROUP BY 1
""")
def topic_nearest(spark, sf_dir):
    points = cluster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("topic_id"), "embedding")
    return topics.assigned(points.drop("topic_id"), topics.centroids(points)).select("item_id", "topic_id", F.round("distance", 6).alias("distance"))


@query("newest_versions", "SELECT version FROM (SELECT DISTINCT 'v' || lpad((conv_id % 6)::VARCHAR, 2, '0') AS version FROM facts) ORDER BY version DESC LIMIT 2")
def newest_versions(spark, sf_dir):
    runs = model.facts(spark, sf_dir).select(F.concat(F.lit("v"), F.lpad((F.col("conv_id") % 6).cast("string"), 2, "0")).alias("version")).distinct().withColumn("created_at", F.col("version"))
    return topics.latest_versions(runs).select("version")


@query("context_full", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, item_id) AS n FROM items), a AS (SELECT *, coalesce(min(CASE WHEN ordinal = 4 THEN n END) OVER (PARTITION BY session_id), max(n) OVER (PARTITION BY session_id)) AS anchor FROM r) SELECT item_id, (n - anchor)::BIGINT AS place FROM a WHERE n - anchor BETWEEN -2 AND 1")
def context_full(spark, sf_dir):
    return sequences.context(model.items(spark, sf_dir), "session_id", ["ordinal", "item_id"], F.col("ordinal") == 4, 2, 1).select("item_id", F.col("place").cast("long").alias("place"))


# annotations


@query("annotations_appended", "SELECT doc_id AS item_id, 'toxic' AS axis, toxic + 1 AS score FROM labels WHERE doc_id % 4 <> 0 AND toxic IS NOT NULL")
def annotations_appended(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "labels").filter("toxic is not null").select(F.col("doc_id").alias("item_id"), F.lit("toxic").alias("axis"), (F.col("toxic") + 1).alias("score"), F.lit("v").alias("annotator_version"))
    return maintenance.annotated(rows.filter("item_id % 4 = 0"), rows.union(rows)).select("item_id", "axis", "score")


@query("annotations_missing", "SELECT doc_id AS item_id FROM labels WHERE doc_id % 3 = 0 OR doc_id % 4 = 0")
def annotations_missing(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    axis = lambda a, keep: rows.filter(keep).select("item_id", F.lit(a).alias("axis"), F.lit("v").alias("annotator_version"))
    return annotate.missing(rows, axis("a", "item_id % 3 <> 0").union(axis("b", "item_id % 4 <> 0")), "v", ["a", "b"])


@query("annotations_without_version", "SELECT doc_id AS item_id FROM labels WHERE doc_id % 2 = 1")
def annotations_without_version(spark, sf_dir):
    rows = cluster.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("v"), F.col("doc_id") % 2).alias("annotator_version"))
    return annotate.without_version(rows, "v0").select("item_id")


@query("annotations_made", "SELECT item_id, axis, (least(length(text), 2000) % 5 + 1)::INT AS score FROM items, (VALUES ('calm'), ('warm')) a(axis)")
def annotations_made(spark, sf_dir):
    def ask(pairs):
        return json.dumps({item: {axis: len(excerpt) % 5 + 1 for axis in ("calm", "warm")} for item, excerpt in pairs})

    return annotate.annotate(model.items(spark, sf_dir), ask, "rule", "v1", ["calm", "warm"], 7).select("item_id", "axis", "score")


@query("vectors_made", "SELECT item_id AS unit_id, least(length(text), 8192)::FLOAT AS x, text_hash FROM items")
def vectors_made(spark, sf_dir):
    made = search.embed(model.items(spark, sf_dir), lambda texts: [[float(len(t)), 1.0] for t in texts], "lengths", 2, memory=lambda: None)
    return made.select("unit_id", F.get("vector", F.lit(0)).alias("x"), "text_hash")


@query("transcript_rendered", "SELECT '# Session s1' || chr(10) || chr(10) || string_agg('## ' || kind || ' — ' || strftime(occurred_at, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY ordinal, item_id) AS markdown FROM items WHERE session_id = 's1' AND tier = 'conversation'")
def transcript_rendered(spark, sf_dir):
    return spark.createDataFrame([(transcript.render(model.items(spark, sf_dir), "s1"),)], "markdown string")


# classes, skills, blame


@query("session_classes", "SELECT session_id, CASE source_kind WHEN 'codex' THEN CASE WHEN conv_id % 3 = 0 THEN 'subagent' WHEN conv_id % 3 = 1 THEN 'automation' ELSE 'interactive' END WHEN 'claude_code' THEN CASE WHEN conv_id % 3 = 0 THEN 'automation' ELSE 'interactive' END WHEN 'opencode' THEN CASE WHEN conv_id % 3 = 0 THEN 'subagent' ELSE 'interactive' END ELSE CASE WHEN conv_id % 3 = 0 THEN 'subagent' ELSE 'interactive' END END AS session_class FROM facts")
def session_classes(spark, sf_dir):
    c = F.col("conv_id") % 3
    flags = model.items(spark, sf_dir).select("session_id", "source_kind", "ordinal", F.when(c == 0, "subagent").alias("thread_source"), (c == 0).alias("subagent"), F.when(c == 1, "codex_exec").alias("originator"), F.lit(False).alias("reviewer"), (c == 0).alias("headless"), F.lit(False).alias("sidechain"), "kind")
    return derive.session_class(flags)


@query("skills_loaded", "SELECT item_id AS event_id, 'k' || (conv_id % 4) AS skill_name, CASE WHEN ordinal % 4 = 1 THEN 'local:/w/skills/k' || (conv_id % 4) || '/SKILL.md' ELSE 'local:skills/k' || (conv_id % 4) || '/SKILL.md' END AS locator, CASE WHEN ordinal % 4 = 1 THEN 'partial' ELSE 'complete' END AS coverage, CASE WHEN ordinal % 4 = 1 THEN 'reader' ELSE 'cat' END AS load_kind FROM items WHERE kind = 'assistant' AND ordinal % 4 IN (1, 3)")
def skills_loaded(spark, sf_dir):
    o, k = F.col("ordinal") % 4, F.concat(F.lit("k"), F.col("conv_id") % 4)
    arguments = F.when(o == 1, F.to_json(F.struct(F.concat(F.lit("/w/skills/"), k, F.lit("/SKILL.md:3-9")).alias("file_path")))).when(o == 3, F.to_json(F.struct(F.concat(F.lit("cat 'skills/"), k, F.lit("/SKILL.md'")).alias("command")))).otherwise('{"command": "cat a | head"}')
    paired = model.items(spark, sf_dir).filter("kind = 'assistant'").select("session_id", F.col("item_id").alias("event_id"), F.col("item_id").alias("result_event_id"), F.col("item_id").alias("call_id"), F.lit("Read").alias("name"), arguments.alias("arguments"), F.lit("text").alias("text"), F.lit(False).alias("truncated"), F.lit("success").alias("status"))
    return tools.skill_loads(paired).select("event_id", "skill_name", "locator", "coverage", "load_kind")


@query("shas_observed", "WITH c AS (SELECT md5(session_id) AS sha FROM facts), p AS (SELECT DISTINCT left(md5(session_id), (4 + conv_id % 3)::INT) AS e_sha FROM facts) SELECT e_sha, CASE WHEN count(*) = 1 THEN min(sha) END AS sha, count(*) AS matches FROM p JOIN c ON starts_with(sha, e_sha) GROUP BY 1")
def shas_observed(spark, sf_dir):
    rows = model.facts(spark, sf_dir).select("conv_id", F.md5("session_id").alias("sha"))
    return blame.observed(rows.select(F.expr("left(sha, int(4 + conv_id % 3))").alias("e_sha")), rows)


@query("blame_truncated", "SELECT md5('commit') AS sha, least(count(*), 64) AS candidates, count(*) > 64 AS truncated FROM items")
def blame_truncated(spark, sf_dir):
    evidence = model.items(spark, sf_dir).select("session_id", F.col("item_id").alias("event_id"), F.substring(F.md5(F.lit("commit")), 1, 8).alias("sha"), F.lit("x").alias("normalized_message"), F.lit("/ws").alias("cwd"))
    commits = spark.range(1).select(F.md5(F.lit("commit")).alias("sha"), F.lit("q").alias("message"))
    return blame.candidates(commits, evidence).groupBy("sha").agg(F.count("*").alias("candidates"), F.max("truncated").alias("truncated"))


_LINES = "l AS (SELECT conv_id * 10 + turn AS line, md5(conv_id::VARCHAR) AS sha, conv_id FROM conversations), f AS (SELECT DISTINCT sha, 's' || left(sha, 1) AS session_id, conv_id FROM l WHERE conv_id % 5 <> 0 UNION SELECT sha, 'other', conv_id FROM l WHERE conv_id % 5 = 1)"


def _blamed(spark, sf_dir):
    c = F.col("conv_id")
    lines = cluster.table(spark, sf_dir, "conversations").select((c * 10 + F.col("turn")).alias("line"), F.md5(c.cast("string")).alias("sha"), "conv_id")
    own = lines.filter("conv_id % 5 <> 0").select("sha", F.concat(F.lit("s"), F.substring("sha", 1, 1)).alias("session_id")).distinct()
    other = lines.filter("conv_id % 5 = 1").select("sha", F.lit("other").alias("session_id")).distinct()
    found = own.union(other).withColumn("rank", F.lit(1)).withColumn("event_id", F.concat_ws("-", "session_id", "sha"))
    return lines, found


@query("blame_coverage", f"WITH {_LINES}, s AS (SELECT line, count(f.sha) AS n FROM l LEFT JOIN f USING (sha) GROUP BY 1) SELECT count(*) AS lines, count(*) FILTER (n = 1) AS matched, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n = 0) AS unresolved, 0::BIGINT AS uncommitted FROM s")
def blame_coverage(spark, sf_dir):
    lines, found = _blamed(spark, sf_dir)
    return blame.coverage(blame.classify(lines.select("line", "sha"), found))


@query("blame_citations", f"WITH {_LINES}, c AS (SELECT session_id, count(DISTINCT line) AS lines, string_agg(DISTINCT sha, ',' ORDER BY sha) AS shas FROM l JOIN f USING (sha) GROUP BY 1) SELECT session_id, 'exact_sha' AS strength, lines, shas FROM c")
def blame_citations(spark, sf_dir):
    lines, found = _blamed(spark, sf_dir)
    out = blame.by_session(blame.classify(lines.select("line", "sha"), found), found)
    return out.select("session_id", "strength", "lines", F.array_join(F.transform("citations", lambda c: c["sha"]), ",").alias("shas"))


# incremental maintenance


@query("import_delta", "SELECT item_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'inserted' ELSE 'touched' END AS change FROM items WHERE conv_id % 3 = 0 OR ordinal % 2 = 0")
def import_delta(spark, sf_dir):
    rows = model.items(spark, sf_dir).select(F.col("item_id").alias("id"), F.col("text_hash").alias("hash"), "conv_id", "ordinal")
    stored = rows.filter("conv_id % 3 <> 0").select("id", F.when(F.col("ordinal") % 2 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return incremental.delta(stored, rows.select("id", "hash"))


@query("maintained_counts", "SELECT session_id, count(*) AS n FROM items GROUP BY 1")
def maintained_counts(spark, sf_dir):
    """A projection that is built, changed in part, and read: counts of the items of each session."""
    rows = model.items(spark, sf_dir)
    counts = lambda df: df.groupBy("session_id").agg(F.count("*").alias("n"))
    dirty, held = incremental.Dirty(spark, _scratch(spark, "dirty")), incremental.Published(spark, _scratch(spark, "counts"))
    dirty.touch(rows)
    incremental.maintain(held, dirty, rows.filter("ordinal < 3"), counts)
    dirty.touch(rows.filter("ordinal >= 3"))
    incremental.maintain(held, dirty, rows, counts)
    return held.read()


@query("provenance_rebuilt", "SELECT item_id, CASE WHEN kind = 'assistant' THEN 'message.assistant' WHEN kind = 'user' AND conv_id % 2 = 0 THEN 'dup.template' ELSE 'default.human' END AS rule FROM items WHERE tier = 'conversation'")
def provenance_rebuilt(spark, sf_dir):
    """Even sessions get one long text in place of many: they, and only they, are derived anew."""
    rows = model.items(spark, sf_dir)
    even = F.col("conv_id") % 2 == 0
    before = rows.withColumn("text", F.concat(F.repeat(F.lit("w"), 201), F.col("item_id"))).withColumn("text_hash", F.md5("text"))
    # the items are in sixteen workspaces, so that even ones are in more than three
    after = before.withColumn("text", F.when(even & (F.col("kind") == "user"), F.repeat(F.lit("t"), 300)).otherwise(F.col("text"))).withColumn("text_hash", F.md5("text")).withColumn("workspace", F.concat(F.lit("/ws/p"), F.col("conv_id") % 16))
    sessions = rows.select("session_id").distinct()
    relations = sessions.select("session_id", F.lit("none").alias("relationship"), F.lit(None).cast("string").alias("parent_session_id"))
    classes = sessions.select("session_id", F.lit("interactive").alias("session_class"))
    held = derive.message_provenance(before, relations, classes)
    touched = rows.filter(even).select("session_id").distinct()
    known = derive.templates(before)
    table, _ = derive.rebuilt_provenance(after, relations, classes, held, touched, spark.createDataFrame([], "text_hash string"), known)
    return table.select("item_id", "rule")


@query("archive_round_trip", "SELECT 'machine' AS kind, 3::BIGINT AS records, 0::BIGINT AS rejected UNION ALL SELECT 'source', (SELECT count(DISTINCT source_kind) FROM facts), 0")
def archive_round_trip(spark, sf_dir):
    path = _scratch(spark, "archive")
    machines = spark.range(3).select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("machine "), "id").alias("name"), F.md5(F.col("id").cast("string")).alias("hash"))
    kinds = model.facts(spark, sf_dir).select("source_kind").distinct()
    none = F.lit(None).cast("timestamp")
    sources = kinds.select(F.col("source_kind").alias("id"), F.col("source_kind").alias("kind"), F.col("source_kind").alias("identity"), F.lit(None).cast("string").alias("path"), none.alias("first_seen_at"), none.alias("updated_at"), F.md5("source_kind").alias("hash"))
    archive.write({"machine": machines, "source": sources}, path, "test", "2024-01-01T00:00:00Z")
    sound, rejected = archive.read(spark, path)
    lost = rejected.agg(F.count("*").alias("rejected"))
    return sound.groupBy("kind").agg(F.count("*").alias("records")).crossJoin(F.broadcast(lost))
