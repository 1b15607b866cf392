"""Derived columns and tables of sessions: authors, tiers, titles, classes, usage, models."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionlake.functions import text

# What a message begins with, who wrote it then, whether its words are a human's, and the rule's name.
TAGS = [
    ("<image name=", "human", "strip_wrapper", "tag.image"),
    ("<command-name>", "human", "strip_wrapper", "tag.command_name"),
    ("<codex_delegation>", "agent", "no", "tag.codex_delegation"),
    ("<subagent_notification>", "harness", "no", "tag.subagent_notification"),
    ("<turn_aborted>", "harness", "no", "tag.turn_aborted"),
    ("<environment_context>", "harness", "no", "tag.environment_context"),
    ("<skill ", "harness", "no", "tag.skill"),
    ("<local-command-stdout>", "harness", "no", "tag.local_command_stdout"),
    ("<local-command-caveat>", "harness", "no", "tag.local_command_caveat"),
    ("<task-notification>", "harness", "no", "tag.task_notification"),
    ("<user_shell_command>", "harness", "no", "tag.user_shell_command"),
    ("<bash-stdout>", "harness", "no", "tag.bash_stdout"),
    ("<bash-input>", "harness", "no", "tag.bash_input"),
    ("caveat: the messages below", "harness", "no", "prefix.claude_caveat"),
    ("the following tool was executed by the user", "harness", "no", "prefix.user_tool_execution"),
    ("warning: the maximum number of unified exec processes", "harness", "no", "prefix.exec_limit"),
]
#: A text that repeats over more sessions and workspaces than this, and is longer, is a template.
TEMPLATE_SPREAD, TEMPLATE_CHARS = 3, 200


def provenance(content: Column, kind: Column, repeated: Column, relationship: Column, session_class: Column) -> Column:
    """(authored_by, sentiment_usable, rule): the first rule that fits."""
    start = F.lower(F.ltrim(content))
    of = lambda a, s, r: F.struct(F.lit(a).alias("authored_by"), F.lit(s).alias("sentiment_usable"), F.lit(r).alias("rule"))
    chain = None
    for prefix, author, usable, rule in TAGS:
        test = start.startswith(prefix)
        chain = F.when(test, of(author, usable, rule)) if chain is None else chain.when(test, of(author, usable, rule))
    return (
        chain.when(session_class == "automation", of("harness", "no", "session.automation"))
        .when(relationship == "subagent", of("agent", "no", "relationship.subagent"))
        .when(kind == "assistant", of("assistant", "no", "message.assistant"))
        .when(repeated & (F.char_length(content) > TEMPLATE_CHARS), of("agent", "no", "dup.template"))
        .otherwise(of("human", "yes", "default.human"))
    )


def templates(items: DataFrame) -> DataFrame:
    """(text_hash) of long user texts that many sessions and workspaces share."""
    long = items.filter((F.col("kind") == "user") & (F.char_length("text") > TEMPLATE_CHARS))
    return long.groupBy("text_hash").agg(F.count_distinct("session_id").alias("s"), F.count_distinct("workspace").alias("w")).filter((F.col("s") > TEMPLATE_SPREAD) & (F.col("w") > TEMPLATE_SPREAD)).select("text_hash")


def message_provenance(items: DataFrame, relations: DataFrame, classes: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Items of the conversation with their authors. relations: session_id, relationship. classes: session_id, session_class. repeated: templates() of all items, if items are not all."""
    known = templates(items) if repeated is None else repeated
    marked = items.filter("tier = 'conversation'").join(known.withColumn("_t", F.lit(True)), "text_hash", "left").join(relations.select("session_id", "relationship"), "session_id", "left").join(classes.select("session_id", "session_class"), "session_id", "left")
    rule = provenance(F.col("text"), F.col("kind"), F.coalesce("_t", F.lit(False)), F.coalesce("relationship", F.lit("none")), F.coalesce("session_class", F.lit("unknown")))
    return marked.withColumn("_p", rule).select("item_id", "session_id", "source_kind", "occurred_at", "_p.*")


def audit(rows: DataFrame, seed: int, most: int = 200) -> DataFrame:
    """A random sample of at most `most` rows of each author, the same for one seed."""
    from sessionlake.operators import sequences

    return sequences.top_per_group(rows, ["authored_by"], [F.md5(F.concat("item_id", F.lit(str(seed)))), F.col("item_id")], most)


def tiers(events: DataFrame) -> DataFrame:
    """History items of events: one of the conversation, tool items, a raw one; of compacted content the conversation only.

    events: event_id, kind, text, compacted boolean, tools array<struct<kind, text>>.
    """
    item = lambda sub, tier, kind, content, policy: F.struct(sub.cast("int").alias("subordinal"), F.lit(tier).alias("tier"), kind.alias("kind"), content.alias("text"), F.lit(policy).alias("semantic_policy"))
    kind = conversation_kind(F.col("kind"), F.col("text"))
    said = F.when(kind.isNotNull() & (F.trim("text") != ""), F.array(item(F.lit(0), "conversation", kind, F.col("text"), "required")))
    empty = F.array().cast("array<struct<subordinal:int,tier:string,kind:string,text:string,semantic_policy:string>>")
    tools = F.transform(F.coalesce("tools", F.array().cast("array<struct<kind:string,text:string>>")), lambda t, n: item(n + 10, "tool", t["kind"], t["text"], "opportunistic"))
    raw = F.array(item(F.lit(100), "raw", F.coalesce("kind", F.lit("event")), F.coalesce("text", F.lit("")), "never"))
    rest = F.when(F.coalesce("compacted", F.lit(False)), empty).otherwise(F.concat(tools, raw))
    return events.select("event_id", F.explode(F.concat(F.coalesce(said, empty), rest)).alias("i")).select("event_id", "i.*")


def conversation_kind(kind: Column, content: Column) -> Column:
    """user, assistant, thinking, or null for what nobody said."""
    from sessionlake.operators import filters

    return F.when(filters.instructions(F.coalesce(kind, F.lit("")), content), None).when(kind.isin("user", "assistant"), kind).when(kind.isin("thinking", "reasoning"), "thinking")


def json_count(document: Column, path: str) -> Column:
    """An integer of at least zero at a path; floats, strings and negative numbers are zero."""
    field = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return F.when(F.schema_of_variant(field) == "BIGINT", F.greatest(F.try_variant_get(F.try_parse_json(document), path, "bigint"), F.lit(0))).otherwise(0).cast("long")


def token_usage(events: DataFrame) -> DataFrame:
    """(session_id, input_tokens, cached_input_tokens, output_tokens): codex counts up, so its greatest counts; the others add up, opencode once per message.

    events: session_id, source_kind, ordinal, message_id, and the three counts,
    null where an event has no usage. A session without any usage has nulls.
    """
    kinds = ["input_tokens", "cached_input_tokens", "output_tokens"]
    used = F.coalesce(*kinds).isNotNull()
    first = events.filter(used).withColumn("_key", F.when(F.col("source_kind") == "opencode", F.concat(F.lit("m:"), F.coalesce("message_id", F.col("ordinal").cast("string")))).otherwise(F.concat(F.lit("o:"), F.col("ordinal").cast("string"))))
    once = first.groupBy("session_id", "source_kind", "_key").agg(*[F.min_by(F.greatest(F.coalesce(k, F.lit(0)), F.lit(0)), "ordinal").alias(k) for k in kinds])
    return once.groupBy("session_id").agg(*[F.when(F.first("source_kind") == "codex", F.max(k)).otherwise(F.sum(k)).alias(k) for k in kinds])


def models(events: DataFrame) -> DataFrame:
    """(session_id, models, primary_model): the most frequent, of equals the least; all of them sorted."""
    named = events.filter(F.trim("model") != "")
    return named.groupBy("session_id").agg(F.array_sort(F.collect_set("model")).alias("models"), F.mode("model", True).alias("primary_model"))


def session_facts(sessions: DataFrame, items: DataFrame, usage: DataFrame, named: DataFrame) -> DataFrame:
    """One row per session from what its items, usage and models say; sessions without items keep their own times."""
    activity = items.groupBy("session_id").agg(F.count("*").alias("event_count"), F.count_if((F.col("kind") == "user") & (F.col("tier") == "conversation")).alias("user_message_count"), F.min("occurred_at").alias("_first"), F.max("occurred_at").alias("_last"))
    joined = sessions.join(activity, "session_id", "left").join(usage, "session_id", "left").join(named, "session_id", "left")
    first, last = F.coalesce("_first", "started_at"), F.coalesce("_last", "updated_at")
    return joined.select(
        "session_id", "source_kind", "workspace", F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("user_message_count", F.lit(0)).alias("user_message_count"), first.alias("first_event_at"), last.alias("last_event_at"), F.greatest(F.lit(0), F.unix_timestamp(last) - F.unix_timestamp(first)).alias("duration_secs"), "input_tokens", "cached_input_tokens", "output_tokens", "models", "primary_model"
    )


def session_class(flags: DataFrame) -> DataFrame:
    """(session_id, session_class) from flags of events: session_id, source_kind, ordinal, thread_source, subagent, originator, reviewer, headless, sidechain, kind.

    codex: its thread source, else a subagent's field, an originator that runs
    by itself, a reviewer's text, else interactive. claude_code: headless is
    automation, only sidechain user turns are a subagent. opencode and omp: a
    parent is a subagent. Others are unknown.
    """
    any_ = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    users = F.col("kind") == "user"
    by = flags.groupBy("session_id", "source_kind").agg(F.min_by("thread_source", F.when(F.col("thread_source").isNotNull(), F.col("ordinal"))).alias("thread"), any_("subagent").alias("sub"), F.min_by("originator", F.when(F.col("originator").isNotNull(), F.col("ordinal"))).alias("origin"), any_("reviewer").alias("review"), any_("headless").alias("headless"), (F.count_if(users) > 0).alias("asked"), F.bool_and(F.when(users, F.coalesce("sidechain", F.lit(False)))).alias("side"))
    codex = F.when(F.col("thread") == "subagent", "subagent").when(F.col("thread").isin("automation", "exec"), "automation").when(F.col("sub") | F.col("review"), "subagent").when(F.col("origin").rlike("(?i)exec|sdk|headless"), "automation").otherwise("interactive")
    claude = F.when(F.col("headless"), "automation").when(F.col("asked") & F.col("side"), "subagent").otherwise("interactive")
    return by.select("session_id", F.when(F.col("source_kind") == "codex", codex).when(F.col("source_kind") == "claude_code", claude).when(F.col("source_kind").isin("opencode", "omp"), F.when(F.col("sub"), "subagent").otherwise("interactive")).otherwise("unknown").alias("session_class"))


def title(native: Column, inline: Column, lines: Column, most: int = 100) -> Column:
    """A session's title: the source's own, one in its events, else the first line that somebody said, cut short."""
    said = F.filter(lines, lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(r"(?i)^(<|#\s*agents\.md|caveat:|\{|\[)"))
    first = F.substring(F.trim(F.get(F.split(F.trim(F.get(said, F.lit(0))), "\n"), F.lit(0))), 1, most)
    pick = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(pick(native), pick(inline), pick(first))


def human_text(content: Column, rule: Column) -> Column:
    return text.after_wrapper(content, rule)


SEGMENTS = "event_id string, kind string, text string, policy string, skipped string"
# What the type, or without one the name, of a part holds that nobody said; the one that must be all of it; and keys of such parts.
TOOLISH_KINDS = ["tool", "function_call", "thinking", "reasoning", "compact"]
TOOLISH_NAMES = ["bash"]
TOOLISH_KEYS = ["tool_use_id", "toolUseResult", "stdout", "stderr"]


def toolish(node: object) -> bool:
    """Whether an object is a tool's call or output, thinking, or a summary."""
    if not isinstance(node, dict):
        return False
    kind = node["type"] if "type" in node else node.get("name")
    kind = kind.lower() if isinstance(kind, str) else ""
    return kind in TOOLISH_NAMES or any(part in kind for part in TOOLISH_KINDS) or any(key in node for key in TOOLISH_KEYS)


def said(node: object) -> list[str]:
    """The texts that nested content holds, in order, each in one line; what toolish objects hold is left out."""
    if isinstance(node, str):
        return [" ".join(node.split())] if node.strip() else []
    if isinstance(node, list):
        return [t for part in node for t in said(part)]
    if isinstance(node, dict) and not toolish(node):
        own = node.get("text")
        return [*(said(own) if isinstance(own, str) else ()), *said(node.get("content"))]
    return []


def _told(root: dict, *path: str) -> str | None:
    node: object = root
    for key in path:
        node = node.get(key) if isinstance(node, dict) else None
    return node if isinstance(node, str) else None


def segment(line: str) -> tuple[str | None, str | None, str, str | None]:
    """(kind, text, policy, why it is skipped) of one event's JSON.

    An event with messages is a conversation of what its users and assistants
    say. Else its role, or its type if that is user or assistant, decides:
    what those two say is searched for, all others are skipped.
    """
    try:
        root = json.loads(line)
    except ValueError:
        return None, None, "never", "no JSON"
    if not isinstance(root, dict):
        return None, None, "never", "non-message event"
    role = _told(root, "role") or _told(root, "message", "role") or _told(root, "payload", "role")
    event_type = _told(root, "type") or _told(root, "payload", "type") or role or "event"
    role = role.lower() if role else event_type if event_type in ("user", "assistant") else None
    if isinstance(root.get("messages"), list):
        texts = [t for m in root["messages"] if isinstance(m, dict) and (_told(m, "role") or "").lower() in ("user", "assistant") for t in said(m)]
        kind, empty = "conversation", "no conversation text in messages"
    elif role in ("user", "assistant"):
        texts = [t for part in (root.get("message"), root.get("payload"), root) for t in said(part)]
        kind, empty = role, "no conversation text"
    else:
        lower = event_type.lower()
        tool = role == "tool" or (role not in ("system", "developer") and (any(w in lower for w in ("tool", "function_call", "exec")) or toolish(root)))
        return None, None, "never", "tool event" if tool else "instruction event" if role in ("system", "developer") else "non-message event"
    return (kind, "\n".join(texts), "required", None) if texts else (None, None, "never", empty)


def segments(events: DataFrame) -> DataFrame:
    """SEGMENTS of events (event_id, line): what of each is searched for, or why nothing is. A null line is no JSON."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *segment(line or "")) for i, line in zip(frame["event_id"], frame["line"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return events.select("event_id", "line").mapInPandas(work, SEGMENTS)


def stored_content(line: str) -> str:
    """What an event keeps as its content: what was said, unless tools were at work in it; else its JSON without spaces; of no JSON a note."""
    from sessionlake.operators import tools

    _, text_, _, skipped = segment(line)
    if text_ is not None and not tools.signals(line):
        return text_
    try:
        return json.dumps(json.loads(line), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return f"[event omitted from projection: {skipped}; raw payload unavailable]"


@F.pandas_udf(StringType())
def contents(lines: pd.Series) -> pd.Series:
    """stored_content() of lines; null for null."""
    return lines.map(lambda line: None if line is None else stored_content(line))


def walk(events: DataFrame, key: str) -> DataFrame:
    """(event_id, value): the strings under a key at any depth of events (event_id, line)."""

    def values(node: object) -> Iterator[str]:
        if isinstance(node, dict):
            if isinstance(node.get(key), str):
                yield node[key]
            for x in node.values():
                yield from values(x)
        elif isinstance(node, list):
            for x in node:
                yield from values(x)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for event_id, line in zip(frame["event_id"], frame["line"]):
                try:
                    rows += [(event_id, v) for v in values(json.loads(line or ""))]
                except ValueError:
                    pass  # a line that is no JSON names nothing
            yield pd.DataFrame(rows, columns=["event_id", "value"])

    return events.select("event_id", "line").mapInPandas(work, "event_id string, value string")


def usage_backfill(items: DataFrame, usage: DataFrame) -> DataFrame:
    """Items whose metadata (JSON) takes over usage (JSON) by message and part, as a merge patch; items without usage stay as they are."""
    from sessionlake.operators import maintenance

    new = usage.select("message_id", "part_id", F.col("usage").alias("_u"))
    joined = items.join(new, ["message_id", "part_id"], "left")
    return joined.withColumn("metadata_json", F.when(F.col("_u").isNull(), F.col("metadata_json")).otherwise(maintenance.merged_json("metadata_json", "_u"))).select(*items.columns)


def long_user_hashes(items: DataFrame, scope: DataFrame, key: str = "session_id") -> DataFrame:
    """(text_hash) of the user texts in scope (a column `key`) that are long enough for a template."""
    long = items.filter((F.col("tier") == "conversation") & (F.col("kind") == "user") & (F.char_length("text") > TEMPLATE_CHARS))
    return long.join(scope.select(key).distinct(), key, "left_semi").select("text_hash").distinct()


def scoped_templates(items: DataFrame, scope: DataFrame, prior: DataFrame) -> DataFrame:
    """templates() among the hashes that a change can have made or unmade: those of the sessions in scope now, and those that touched events had before (prior: text_hash). The spread is that of all items."""
    candidates = long_user_hashes(items, scope).union(prior.select("text_hash")).distinct()
    return templates(items.filter("tier = 'conversation'").join(candidates, "text_hash", "left_semi"))


def rebuilt_provenance(items: DataFrame, relations: DataFrame, classes: DataFrame, held: DataFrame, touched: DataFrame, prior: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(message provenance after a change, session_id of the sessions that were derived anew).

    items are those after the change; held is the table before it. touched
    sessions are widened by lineage, either way, and by the sessions with a text
    that became a template or is none any more (known: text_hash of the
    templates before; prior: of the long texts that touched events had). All
    others keep their rows.
    """
    from sessionlake.operators import lineage
    from sessionlake.streaming import incremental

    edges = relations.filter("parent_session_id is not null").select(F.col("session_id").alias("a"), F.col("parent_session_id").alias("b"))
    now = scoped_templates(items, touched, prior)
    candidates = long_user_hashes(items, touched).union(prior.select("text_hash")).distinct()
    before = known.select("text_hash").distinct().join(candidates, "text_hash", "left_semi")
    turned = now.join(before, "text_hash", "left_anti").union(before.join(now, "text_hash", "left_anti"))
    bearers = items.filter("kind = 'user'").join(turned, "text_hash", "left_semi").select("session_id")
    scope = lineage.affected(touched, edges).union(bearers).distinct()
    every = known.select("text_hash").distinct().join(candidates, "text_hash", "left_anti").union(now)
    return incremental.scoped(lambda own: message_provenance(own, relations, classes, every), items, held, scope), scope
