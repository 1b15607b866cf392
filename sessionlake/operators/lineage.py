"""Session lineage: parents, roots, forks, affected sets."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.functions import ids
from sessionlake.operators import graphs


def parents(sessions: DataFrame, hints: DataFrame) -> DataFrame:
    """(session_id, parent_session_id): hints' parent_external_id resolved on the same machine and source, never to itself.

    Where the exact external id is missing, an omp id that is only a suffix
    after an underscore counts if one session alone ends in it.
    """
    own = sessions.select("session_id", "machine_id", "source_kind", "external_id").join(hints.select("session_id", "parent_external_id"), "session_id")
    other = sessions.select(F.col("session_id").alias("p"), F.col("machine_id").alias("pm"), F.col("source_kind").alias("pk"), F.col("external_id").alias("pe"))
    exact = own.join(other, (F.col("machine_id") == F.col("pm")) & (F.col("source_kind") == F.col("pk")) & (F.col("parent_external_id") == F.col("pe")) & (F.col("session_id") != F.col("p")))
    first = exact.groupBy("session_id").agg(F.min("p").alias("exact"))
    tail = other.withColumn("tail", F.regexp_extract("pe", r"_([^_]+)$", 1)).filter("tail <> '' and pk = 'omp'")
    loose = own.filter("source_kind = 'omp'").join(tail, (F.col("machine_id") == F.col("pm")) & (F.col("parent_external_id") == F.col("tail")) & (F.col("session_id") != F.col("p"))).groupBy("session_id").agg(F.count_distinct("p").alias("n"), F.min("p").alias("loose")).filter("n = 1")
    return own.select("session_id").join(first, "session_id", "left").join(loose, "session_id", "left").select("session_id", F.coalesce("exact", "loose").alias("parent_session_id"))


def roots(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(session_id, root_session_id) by pointer doubling; a row without a parent is its own root. A cycle raises an error.

    edges: session_id, parent_session_id (null for none, or a session that has no row). Each round doubles the
    distance that a pointer has gone, so depth d takes log2(d) rounds; rounds are written to the shared folder.
    """
    held = cluster.materialize(edges.select("session_id", F.coalesce("parent_session_id", "session_id").alias("up"), F.col("parent_session_id").isNull().alias("done")), "roots")
    for _ in range(most_rounds):
        if not held.filter("not done").limit(1).count():
            return held.select("session_id", F.col("up").alias("root_session_id"))
        over = held.select(F.col("session_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("next_done"))
        before, held = held, cluster.materialize(held.join(over, "up", "left").select("session_id", F.coalesce("next", "up").alias("up"), (F.col("done") | F.coalesce("next_done", F.lit(True))).alias("done")), "roots")
        cluster.discard(before)
    raise ValueError("sessions are each other's parents")


def _chained(hashes: pd.Series) -> pd.Series:
    """For each list of hashes a list of names of its beginnings, from the first hash to all of them."""

    def one(own) -> list[bytes]:
        out, last = [], b""
        for h in own:
            last = hashlib.blake2b(last + b"\0" + str(h).encode(), digest_size=16).digest()
            out.append(last)
        return out

    return hashes.map(one)


#: Sessions of one beginning that one task looks through at once.
BRANCH_ROWS = 50_000


def _first_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The sessions of one beginning, earliest first, that can be among the first two of another branch and external id for anyone."""
    kept: list[int] = []
    branch, name = rows["branch"].tolist(), rows["external_id"].tolist()
    order = rows.assign(_n=range(len(rows))).sort_values(["started_at", "session_id"])["_n"].tolist()
    for k in order:
        # whoever sees k is of another branch and another name; is there such a one that has not met two others before k?
        before = [(branch[j], name[j]) for j in kept]
        seers = {(b, n) for b in {None, *(b for b, _ in before)} for n in {None, *(n for _, n in before)} if b != branch[k] and n != name[k]}
        if any(sum(b2 != b and n2 != n for b2, n2 in before) < 2 for b, n in seers):
            kept.append(k)
    return rows.iloc[kept]


def forks(events: DataFrame, sessions: DataFrame, shared: int = 8) -> DataFrame:
    """(session_id, parent_session_id, common): the session of the same machine that a session's first events repeat.

    The parent comes earlier, has another external id, and their common prefix
    has at least `shared` events and is shorter than both. Two parents with one
    length of prefix are none. Sessions without a time, a machine or an external
    id are left out.

    No pair is compared. Each beginning of each session has a name; sessions
    meet where they have one beginning and go on differently. Of those a
    beginning keeps only the few earliest that any other can have for a parent,
    first in shares of about BRANCH_ROWS sessions, then over the shares, so a
    beginning that a third of all sessions have is no single task's.
    """
    own = sessions.select("session_id", "machine_id", "external_id", "started_at").dropna()
    ordered = events.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "hash"))), lambda e: e["hash"].cast("string")).alias("hashes")).filter(F.size("hashes") > shared)
    chained = F.pandas_udf(_chained, "array<binary>")
    steps = ordered.withColumn("names", chained("hashes")).select("session_id", F.posexplode(F.expr(f"slice(names, {shared}, size(names) - {shared})")).alias("k", "start"), F.col("names")).select("session_id", (F.col("k") + shared).cast("long").alias("common"), "start", F.get("names", F.col("k") + shared).alias("branch"))
    nodes = steps.join(own, "session_id")
    key = ["machine_id", "start"]
    met = nodes.groupBy(*key).agg(F.count("*").alias("_n"), F.min("branch").alias("_a"), F.max("branch").alias("_b")).filter("_a <> _b").select(*key, "_n")
    rows = nodes.join(met, key).withColumn("_share", F.pmod(F.xxhash64("session_id"), F.ceil(F.col("_n") / BRANCH_ROWS)))
    thin = ["machine_id", "start", "branch", "session_id", "external_id", "started_at"]
    schema = "machine_id string, start binary, branch binary, session_id string, external_id string, started_at timestamp"
    cast = rows.select(F.col("machine_id").cast("string"), "start", "branch", F.col("session_id").cast("string"), F.col("external_id").cast("string"), F.col("started_at").cast("timestamp"), "_share")
    first = cast.groupBy(*key, "_share").applyInPandas(lambda g: _first_of(g)[thin], schema).groupBy(*key).applyInPandas(lambda g: _first_of(g)[thin], schema)
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("started_at", "session_id", "external_id", "branch"))).alias("firsts"))
    fits = lambda p: (p["branch"] != F.col("branch")) & (p["external_id"] != F.col("external_id")) & (F.struct(p["started_at"], p["session_id"]) < F.struct("started_at", "session_id"))
    found = rows.join(listed, key).select("session_id", "common", F.transform(F.filter("firsts", fits), lambda p: p["session_id"]).alias("parents")).filter(F.size("parents") > 0)
    best = found.groupBy("session_id").agg(F.max("common").alias("common"), F.max_by("parents", "common").alias("parents"))
    return best.filter(F.size("parents") == 1).select("session_id", F.get("parents", F.lit(0)).alias("parent_session_id"), "common")


def affected(touched: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id): touched sessions and all that edges (a, b), either way, lead to.

    These are the components that touched sessions are in, found in a number of
    rounds that grows with the logarithm of the sessions, however long a chain is.
    """
    own = touched.select("session_id").distinct()
    labels = graphs.components(edges)
    met = labels.join(own, labels["node"] == own["session_id"], "left_semi").select("label").distinct()
    return own.union(labels.join(met, "label", "left_semi").select("node")).distinct()


def inherited(items: DataFrame, relations: DataFrame) -> DataFrame:
    """(item_id, inherited): whether a subagent's message stands, by kind and hash of text, in its parent too."""
    own = items.join(relations.filter("relationship = 'subagent'").select("session_id", "parent_session_id"), "session_id")
    of_parent = items.select(F.col("session_id").alias("parent_session_id"), "kind", "text_hash").distinct().withColumn("inherited", F.lit(True))
    return own.join(of_parent, ["parent_session_id", "kind", "text_hash"], "left").select("item_id", F.coalesce("inherited", F.lit(False)).alias("inherited"))


def sidechains(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, relationships) of sidechain events that one log holds inline.

    events: session_id, event_id, uuid, parent_uuid, sidechain, task_tool_use.
    overrides: event_id, session_id, the synthetic session of the topmost
    sidechain ancestor. relationships: session_id, parent_session_id,
    relationship, rule of each synthetic session: a subagent of the log's
    session if an event above its top that is no sidechain used the Task tool,
    else none. An event that names no uuid is its own top. A chain that leads
    to itself raises an error. Of repeated uuids in a session the least event
    counts.
    """
    key = lambda c: F.concat_ws("/", "session_id", c)
    own = events.select("session_id", "event_id", F.coalesce("uuid", F.concat(F.lit("event:"), "event_id")).alias("uuid"), "parent_uuid", F.coalesce("sidechain", F.lit(False)).alias("side"), F.coalesce("task_tool_use", F.lit(False)).alias("task"))
    nodes = own.groupBy("session_id", "uuid").agg(F.min_by(F.struct("parent_uuid", "side", "task"), "event_id").alias("n")).select("session_id", "uuid", "n.*")
    above = nodes.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("side").alias("above_side"))
    linked = nodes.join(above, ["session_id", "parent_uuid"], "left")
    tops = roots(linked.filter("side").select(key("uuid").alias("session_id"), F.when(F.coalesce("above_side", F.lit(False)), key("parent_uuid")).alias("parent_session_id")))
    named = own.filter("side").join(tops.withColumnRenamed("session_id", "_own"), key("uuid") == F.col("_own"))
    child = ids.stable_id(F.lit("session_relationship"), F.lit("inline"), F.col("session_id"), F.col("root_session_id"))
    overrides = named.select("event_id", child.alias("session_id"))
    # upwards from each top: the first event that is no sidechain and used the tool, or the end of the chain, stops the walk
    stops = linked.select(key("uuid").alias("session_id"), F.when(F.col("above_side").isNotNull() & ~(F.col("task") & ~F.col("side")), key("parent_uuid")).alias("parent_session_id"))
    reached = roots(stops).select(F.col("session_id").alias("_top"), F.col("root_session_id").alias("_end"))
    ends = nodes.select(key("uuid").alias("_end"), (F.col("task") & ~F.col("side")).alias("_task"))
    chains = named.select("session_id", "root_session_id", child.alias("child")).distinct().join(reached, F.col("root_session_id") == F.col("_top")).join(ends, "_end")
    linked_to = F.col("_task")
    relationships = chains.select(F.col("child").alias("session_id"), F.when(linked_to, F.col("session_id")).alias("parent_session_id"), F.when(linked_to, "subagent").otherwise("none").alias("relationship"), F.when(linked_to, "claude.inline_sidechain").otherwise("claude.inline_orphan").alias("rule"))
    return overrides, relationships


def effective(items: DataFrame, overrides: DataFrame, relationships: DataFrame, inherited_items: DataFrame | None = None) -> DataFrame:
    """Items with effective_session_id (an override's session, else their own) and its relationship, none where there is none.

    overrides: event_id, session_id. inherited_items: (item_id, inherited) as
    inherited() gives them: what a subagent took over from its parent has no
    relationship, unless an override moved it.
    """
    moved = overrides.select("event_id", F.col("session_id").alias("_over"))
    joined = items.join(moved, "event_id", "left").withColumn("effective_session_id", F.coalesce("_over", "session_id"))
    known = relationships.select(F.col("session_id").alias("effective_session_id"), F.col("relationship").alias("_rel"))
    joined = joined.join(known, "effective_session_id", "left")
    relation = F.coalesce("_rel", F.lit("none"))
    if inherited_items is not None:
        joined = joined.join(inherited_items.select("item_id", F.col("inherited").alias("_inh")), "item_id", "left")
        relation = F.when(F.col("_over").isNull() & F.coalesce("_inh", F.lit(False)) & (relation == "subagent"), "none").otherwise(relation)
    return joined.select(*[F.col(c) for c in items.columns], "effective_session_id", relation.alias("relationship"))


def scoped_inherited(items: DataFrame, relations: DataFrame, scope: DataFrame) -> DataFrame:
    """inherited() for the edges alone whose child or parent is in scope (session_id)."""
    own = scope.select("session_id").distinct()
    by_child = relations.join(own, "session_id", "left_semi")
    by_parent = relations.join(own.select(F.col("session_id").alias("parent_session_id")), "parent_session_id", "left_semi").select(*relations.columns)
    return inherited(items, by_child.unionByName(by_parent).dropDuplicates(["session_id", "parent_session_id"]))


def omp_identity(logs: DataFrame) -> DataFrame:
    """(path, external_id, parent_external_id, relationship) of omp logs (path, parent_session).

    A log in a folder that is named as another log beside it is that log's
    subagent: names along the chain, joined by slashes, are its id. A log on its
    own whose session line names a parent is a fork of it; the parent's name is
    that of a file if it ends in .jsonl. Paths are unique.
    """
    bare = lambda c: F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", "")
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    own = logs.select("path", "parent_session").withColumn("folder", F.concat(bare(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), F.lit(".jsonl")))
    known = logs.select(F.col("path").alias("folder"), F.lit(True).alias("_is"))
    edges = own.join(known, "folder", "left").select("path", "parent_session", F.when(F.col("_is"), F.col("folder")).alias("up"))
    top = roots(edges.select(F.col("path").alias("session_id"), F.col("up").alias("parent_session_id"))).select(F.col("session_id").alias("path"), F.col("root_session_id").alias("top"))
    # each folder between the top log and this one is named as a log of the chain
    parts, depth = F.split("path", "/"), F.size(F.split("path", "/")) - F.size(F.split("top", "/"))
    chain = F.concat(F.transform(F.slice(parts, F.size(parts) - depth, depth), bare), F.array(bare(name(F.col("path")))))
    said = F.trim("parent_session")
    forked = F.when(said != "", F.when(said.endswith(".jsonl"), bare(name(said))).otherwise(said))
    inner = F.size("chain") > 1
    return edges.join(top, "path").withColumn("chain", chain).select("path", F.array_join("chain", "/").alias("external_id"), F.when(inner, F.array_join(F.slice("chain", F.lit(1), F.size("chain") - 1), "/")).otherwise(forked).alias("parent_external_id"), F.when(inner, "subagent").when(forked.isNotNull(), "fork").otherwise("none").alias("relationship"))


# Rules of kinds whose logs name no parent.
UNTOLD = {"pi_agent": "pi_agent.capture_gap", "omp": "omp.root", "hermes": "hermes.capture_gap"}


def hint(source_kind: Column, metadata: Column) -> Column:
    """(parent_external_id, relationship, rule) that a session's metadata names by itself.

    claude_code: a path into a folder of subagents. opencode: a parent id. omp:
    what omp_identity() told. Blank names are none; other kinds name none.
    """
    at = lambda p: F.nullif(F.trim(F.get_json_object(metadata, p)), F.lit(""))
    of = lambda parent, relation, rule: F.struct(parent.alias("parent_external_id"), relation.alias("relationship"), rule.alias("rule"))
    by_path, by_id, by_omp = claude_hint(F.get_json_object(metadata, "$.path")), at("$.opencode_parent_id"), at("$.omp_parent_external_id")
    relation = F.coalesce(F.when(at("$.omp_relationship").isin("subagent", "fork"), at("$.omp_relationship")), F.lit("none"))
    untold = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNTOLD.items() for x in kv]), source_kind), F.lit("default.none"))
    return (
        F.when((source_kind == "claude_code") & by_path.isNotNull(), of(by_path, F.lit("subagent"), F.lit("claude.subagent_path")))
        .when((source_kind == "opencode") & by_id.isNotNull(), of(by_id, F.lit("subagent"), F.lit("opencode.parent_id")))
        .when((source_kind == "omp") & by_omp.isNotNull(), of(by_omp, relation, F.when(relation == "subagent", "omp.artifact_path").when(relation == "fork", "omp.parent_session").otherwise("omp.root")))
        .otherwise(of(F.lit(None).cast("string"), F.lit("none"), untold))
    )


def claude_hint(path: Column) -> Column:
    """The parent's external id that a subagent's path names, or null."""
    found = F.regexp_extract(path, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})/subagents/agent-[^/]+$", 1)
    return F.when(found != "", found)


def notified(mentions: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, parent_session_id, rule): children that parents' notifications name by external id on the same machine; of two parents the first, and the rule says so."""
    child = sessions.select("session_id", "machine_id", "external_id")
    met = mentions.select(F.col("session_id").alias("parent"), "machine_id", F.col("agent_path").alias("external_id"), "ordinal").join(child, ["machine_id", "external_id"]).filter(F.col("parent") != F.col("session_id"))
    return met.groupBy("session_id").agg(F.min_by("parent", F.struct("parent", "ordinal")).alias("parent_session_id"), F.count_distinct("parent").alias("n")).select("session_id", "parent_session_id", F.when(F.col("n") > 1, "notification.collision").otherwise("notification").alias("rule"))
