"""The canonical tables over the driver's tables, for Spark and, as views, for DuckDB.

A conversation is a session and a turn a history item; what the driver's tables
lack (times, workspaces, models, usage, classes) follows from the ids by rules
that both engines state.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster

EPOCH = "2024-01-01 00:00:00"

VIEWS = {
    "items": """
  SELECT 'i' || conv_id || '-' || turn AS item_id, 's' || conv_id AS session_id, conv_id, turn AS ordinal, role AS kind, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS occurred_at, '/ws/p' || (conv_id % 8) AS workspace,
    CASE conv_id % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude_code' WHEN 2 THEN 'opencode' ELSE 'omp' END AS source_kind,
    'm' || (conv_id % 3) AS machine_id,
    CASE WHEN role = 'system' THEN 'raw' WHEN turn % 5 = 4 THEN 'tool' ELSE 'conversation' END AS tier,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'model-' || ((conv_id + turn // 4) % 3) END AS model,
    md5(text) AS text_hash
  FROM conversations""",
    "provenance": """
  SELECT item_id, session_id, source_kind, workspace, occurred_at, text, kind, ordinal,
    CASE WHEN kind = 'system' THEN 'harness' WHEN conv_id % 5 = 0 THEN 'agent' WHEN kind = 'assistant' THEN 'assistant' ELSE 'human' END AS authored_by
  FROM items""",
    "facts": """
  SELECT session_id, any_value(conv_id) AS conv_id, any_value(source_kind) AS source_kind, any_value(workspace) AS workspace,
    CASE WHEN any_value(conv_id) % 7 = 0 THEN NULL WHEN any_value(conv_id) % 5 = 0 THEN 'subagent' ELSE 'interactive' END AS session_class,
    CASE WHEN any_value(conv_id) % 4 = 3 THEN NULL ELSE 'model-' || (any_value(conv_id) % 3) END AS primary_model,
    CASE WHEN any_value(conv_id) % 6 = 0 THEN NULL ELSE sum(CASE WHEN kind = 'user' THEN length(text) ELSE 0 END)::BIGINT END AS input_tokens,
    CASE WHEN any_value(conv_id) % 6 = 0 THEN NULL ELSE (any_value(conv_id) * 3) END AS cached_input_tokens,
    CASE WHEN any_value(conv_id) % 6 = 0 THEN NULL ELSE sum(CASE WHEN kind = 'assistant' THEN length(text) ELSE 0 END)::BIGINT END AS output_tokens,
    count(*) AS event_count, count(*) FILTER (kind = 'user') AS user_message_count,
    min(occurred_at) AS first_event_at, max(occurred_at) AS last_event_at, date_diff('second', min(occurred_at), max(occurred_at)) AS duration_secs
  FROM items GROUP BY session_id""",
    "toks": """
  SELECT item_id, session_id, workspace, kind, authored_by, occurred_at,
    list_filter(list_transform(regexp_extract_all(array_to_string(list_filter(string_split_regex(array_to_string(list_filter(string_split_regex(text, '(?m)^[^\\S\\n]*```[^\\n]*$'), lambda s, i : i % 2 = 1), chr(10)), '\\s+'),
      lambda c : NOT regexp_matches(regexp_replace(c, '^[()\\[\\]<>,;]+', ''), '^(/|~/)|://')), ' '), '[\\p{L}\\p{N}'']+'), lambda t : translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda t : NOT regexp_matches(t, '[0-9]')) AS toks
  FROM provenance""".replace("\\\\", "\\"),
}


def with_views(sql: str) -> str:
    """A statement behind the views that it names, and those that they name."""
    needed: list[str] = []

    def add(text: str, own: str = "") -> None:
        for name in VIEWS:
            if name not in (*needed, own) and re.search(rf"\b{name}\b", text):
                add(VIEWS[name], name)
                if name not in needed:
                    needed.append(name)

    add(sql)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History items: one per turn."""
    c, t = F.col("conv_id"), F.col("turn")
    return cluster.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("i"), c, F.lit("-"), t).alias("item_id"),
        F.concat(F.lit("s"), c).alias("session_id"),
        "conv_id",
        t.alias("ordinal"),
        F.col("role").alias("kind"),
        "text",
        F.timestamp_add("MINUTE", t.cast("int"), F.timestamp_add("HOUR", c.cast("int"), F.lit(EPOCH).cast("timestamp"))).alias("occurred_at"),
        F.concat(F.lit("/ws/p"), c % 8).alias("workspace"),
        F.element_at(F.array(*map(F.lit, ("codex", "claude_code", "opencode", "omp"))), (c % 4 + 1).cast("int")).alias("source_kind"),
        F.concat(F.lit("m"), c % 3).alias("machine_id"),
        F.when(F.col("role") == "system", "raw").when(t % 5 == 4, "tool").otherwise("conversation").alias("tier"),
        F.when((F.col("role") == "assistant") & (t % 4 == 1), F.concat(F.lit("model-"), (c + F.floor(t / 4)) % 3)).alias("model"),
        F.md5("text").alias("text_hash"),
    )


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote each item."""
    author = F.when(F.col("kind") == "system", "harness").when(F.col("conv_id") % 5 == 0, "agent").when(F.col("kind") == "assistant", "assistant").otherwise("human")
    return items(spark, sf_dir).withColumn("authored_by", author)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of facts per session, by one aggregation."""
    c = F.col("conv_id")
    size = F.char_length("text")
    used = lambda value: F.when(c % 6 != 0, value)
    grouped = items(spark, sf_dir).groupBy("session_id", "conv_id", "source_kind", "workspace").agg(
        F.sum(F.when(F.col("kind") == "user", size).otherwise(0)).alias("_in"),
        F.sum(F.when(F.col("kind") == "assistant", size).otherwise(0)).alias("_out"),
        F.count("*").alias("event_count"),
        F.count_if(F.col("kind") == "user").alias("user_message_count"),
        F.min("occurred_at").alias("first_event_at"),
        F.max("occurred_at").alias("last_event_at"),
    )
    return grouped.select(
        "session_id",
        "conv_id",
        "source_kind",
        "workspace",
        F.when(c % 7 == 0, None).when(c % 5 == 0, "subagent").otherwise("interactive").alias("session_class"),
        F.when(c % 4 != 3, F.concat(F.lit("model-"), c % 3)).alias("primary_model"),
        used(F.col("_in")).alias("input_tokens"),
        used(c * 3).alias("cached_input_tokens"),
        used(F.col("_out")).alias("output_tokens"),
        "event_count",
        "user_message_count",
        "first_event_at",
        "last_event_at",
        F.greatest(F.lit(0), F.unix_timestamp("last_event_at") - F.unix_timestamp("first_event_at")).alias("duration_secs"),
    )
