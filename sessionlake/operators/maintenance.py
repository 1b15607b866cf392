"""Import, export, pruning, raw objects and their compaction. Nothing is changed in place: each function returns what the tables become."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionlake.functions import ids


def import_records(stored: DataFrame, records: DataFrame, key: str = "id", mark: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): records whose key is not stored, each once. counts has one row: inserted, duplicates, conflicts.

    A conflict has a stored key and another hash; append only if there are none
    (see checked()).
    """
    once = records.dropDuplicates([key, mark])
    joined = once.join(stored.select(F.col(key), F.col(mark).alias("_have")), key, "left")
    fresh = joined.filter("_have is null").drop("_have").select(*records.columns)
    several = fresh.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").count()
    counts = joined.agg(F.count_if(F.col("_have").isNull()).alias("inserted"), F.count_if(F.col("_have") == F.col(mark)).alias("stored_before"), (F.count_if(F.col("_have") != F.col(mark)) + several).alias("conflicts")).crossJoin(F.broadcast(records.agg(F.count("*").alias("_all")))).select("inserted", (F.col("_all") - F.col("inserted") - F.col("conflicts")).alias("duplicates"), "conflicts")
    return fresh, counts


def checked(stored: DataFrame, records: DataFrame, key: str = "id", mark: str = "hash") -> DataFrame:
    """Rows to append; the first record whose key is stored with another hash stops the job."""
    joined = records.dropDuplicates([key, mark]).join(stored.select(F.col(key), F.col(mark).alias("_have")), key, "left")
    sound = F.when(F.col("_have").isNotNull() & (F.col("_have") != F.col(mark)), F.raise_error(F.concat(F.lit("another record has the id "), F.col(key).cast("string")))).otherwise(F.col("_have"))
    return joined.withColumn("_have", sound).filter("_have is null").drop("_have").select(*records.columns)


def upsert_sessions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sessions after an update: times only move forward, a title that is not blank replaces, metadata is taken over where the workspace is news.

    Both: session_id, title, updated_at, metadata_json.
    """
    latest = incoming.groupBy("session_id").agg(F.max_by(F.struct("title", "updated_at", "metadata_json"), F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp"))).alias("new"))
    path = lambda c: F.get_json_object(c, "$.workspace_path")
    both = stored.join(latest, "session_id", "full")
    news = path(F.col("metadata_json")).isNull() & path(F.col("new.metadata_json")).isNotNull()
    return both.select("session_id", F.coalesce(F.when(F.trim("new.title") != "", F.col("new.title")), "title", "new.title").alias("title"), F.greatest("updated_at", "new.updated_at").alias("updated_at"), F.when(news, F.col("new.metadata_json")).otherwise(F.coalesce("metadata_json", "new.metadata_json")).alias("metadata_json"))


def _patched(document: object, patch: object) -> object:
    if not isinstance(patch, dict):
        return patch
    out = dict(document) if isinstance(document, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = _patched(out.get(key), value)
    return out


@F.pandas_udf(StringType())
def merged_json(document: pd.Series, patch: pd.Series) -> pd.Series:
    """A JSON merge patch (RFC 7396) on a document: objects merge at any depth, a null takes a key away, anything else replaces.

    Numbers, lists and booleans stay what they are. A null document is an empty
    object; a null patch, or a side that is no JSON, leaves the document alone.
    """

    def one(old: str | None, new: str | None) -> str | None:
        if new is None:
            return old
        try:
            return json.dumps(_patched(json.loads(old) if old is not None else {}, json.loads(new)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return old

    return pd.Series([one(o, n) for o, n in zip(document, patch)], dtype=object)


def refreshed(events: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with patched metadata, event_id of those that changed).

    patches: event_id, hash, metadata_json, one of each event; a patch counts
    only for an event of the same hash, and only if it changes something.
    """
    wanted = patches.select("event_id", F.col("hash").alias("_h"), F.col("metadata_json").alias("_p"))
    joined = events.join(wanted, "event_id", "left").withColumn("_new", F.when(F.col("_h") == F.col("hash"), merged_json("metadata_json", "_p")))
    changed = F.coalesce(F.col("_new") != F.col("metadata_json"), F.col("_new").isNotNull() & F.col("metadata_json").isNull())
    marked = joined.withColumn("_c", changed)
    return marked.withColumn("metadata_json", F.when(F.col("_c"), F.col("_new")).otherwise(F.col("metadata_json"))).select(*events.columns), marked.filter("_c").select("event_id")


def activity(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(session_id, event_count, first_event_at, last_event_at) of events, added to the activity before them."""
    own = events.groupBy("session_id").agg(F.count("*").alias("event_count"), F.min("occurred_at").alias("first_event_at"), F.max("occurred_at").alias("last_event_at"))
    if before is None:
        return own
    return before.unionByName(own).groupBy("session_id").agg(F.sum("event_count").alias("event_count"), F.min("first_event_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at"))


def proportional(groups: DataFrame, weight: str, known: int, to: str) -> DataFrame:
    """Adds each group's share of a known number, rounded half up in whole numbers."""
    whole = F.sum(weight).over(Window.partitionBy())
    return groups.withColumn(to, F.floor((F.lit(known) * F.col(weight) * 2 + whole) / (whole * 2)))


def count_deltas(counts: DataFrame, deltas: DataFrame, by: str = "source_kind") -> DataFrame:
    """Status counts after deltas, which may be negative."""
    names = [c for c in counts.columns if c != by]
    return counts.unionByName(deltas).groupBy(by).agg(*[F.greatest(F.lit(0), F.sum(n)).alias(n) for n in names])


def export_closure(sessions: DataFrame, chosen: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The rows of each table that chosen sessions depend on. tables: name -> (rows, key column); a key is a column of sessions or session_id."""
    own = sessions.join(chosen.select("session_id").distinct(), "session_id", "left_semi")
    return {"sessions": own} | {name: rows.join(own.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi") for name, (rows, key) in tables.items()}


def envelopes(records: DataFrame, kind: str, schema: str, producer: str, produced_at: str) -> DataFrame:
    """(value) lines of JSON: a record with its kind, id and hash around it."""
    return records.select(F.to_json(F.struct(F.lit(schema).alias("schema"), "id", "hash", F.lit(producer).alias("producer"), F.lit(produced_at).alias("produced_at"), F.lit(kind).alias("kind"), F.struct(*records.columns).alias("payload"))).alias("value"))


def blob_rows(artifacts: DataFrame) -> DataFrame:
    """(hash, size, content) of raw artifacts for a JSONL export, content in base64."""
    return artifacts.select("hash", F.octet_length("content").cast("long").alias("size"), F.base64("content").alias("content"))


def verified_blobs(rows: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a blob import: size and hash must agree, and the hash belong to a known artifact."""
    own = rows.withColumn("_bytes", F.unbase64("content"))
    known = artifacts.select("hash").distinct().withColumn("_known", F.lit(True))
    sound = F.coalesce(F.col("_known") & (F.octet_length("_bytes") == F.col("size")) & (ids.content_hash(F.col("_bytes")) == F.col("hash")), F.lit(False))
    judged = own.join(known, "hash", "left").withColumn("_ok", sound)
    return judged.filter("_ok").select("hash", "size", F.col("_bytes").alias("content")), judged.filter("not _ok").select("hash", "size")


def missing_blobs(referenced: DataFrame, stored: DataFrame) -> DataFrame:
    return referenced.select("hash").distinct().join(stored.select("hash"), "hash", "left_anti")


def prune_plan(chosen: DataFrame, tables: dict[str, DataFrame], content: dict[str, str] | None = None) -> DataFrame:
    """(table, rows, bytes): what a removal of sessions takes with it, by table; bytes are those of the table's column of content, if it is told."""
    wanted = chosen.select("session_id").distinct()
    size = lambda name: F.coalesce(F.sum(F.octet_length(content[name])), F.lit(0)) if content and name in content else F.lit(0)
    parts = [rows.join(wanted, "session_id", "left_semi").agg(F.count("*").alias("rows"), size(name).cast("long").alias("bytes")).select(F.lit(name).alias("table"), "rows", "bytes") for name, rows in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pruned(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """A table without the chosen sessions."""
    return rows.join(chosen.select("session_id").distinct(), "session_id", "left_anti")


def orphans(rows: DataFrame, key: str, *users: tuple[DataFrame, str]) -> DataFrame:
    """Rows that no other table refers to."""
    for other, column in users:
        rows = rows.join(other.select(F.col(column).alias("_u")).distinct(), F.col(key) == F.col("_u"), "left_anti")
    return rows


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each path, of equals the greatest hash."""
    order = Window.partitionBy("path").orderBy(F.desc("first_seen_at"), F.desc("hash"))
    return artifacts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def compaction(artifacts: DataFrame) -> DataFrame:
    """(hash, path, kept_hash): older artifacts that are the beginning of the newest one of their path, and may go."""
    newest = latest_artifacts(artifacts).select("path", F.col("hash").alias("kept_hash"), F.col("content").alias("_whole"))
    return artifacts.join(newest, "path").filter((F.col("hash") != F.col("kept_hash")) & (F.octet_length("content") <= F.octet_length("_whole")) & (F.substring("_whole", F.lit(1), F.octet_length("content")) == F.col("content"))).select("hash", "path", "kept_hash")


def repointed(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Events with references to compacted artifacts moved to those that are kept."""
    moves = plan.select(F.col("hash").alias("raw_artifact_hash"), "kept_hash")
    return events.join(moves, "raw_artifact_hash", "left").withColumn("raw_artifact_hash", F.coalesce("kept_hash", "raw_artifact_hash")).drop("kept_hash").select(*events.columns)


def reassembled(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """(manifest_hash, content): the objects of each manifest in order. A missing object stops the job."""
    joined = entries.join(objects.select(F.col("hash").alias("object_hash"), "content"), "object_hash", "left")
    whole = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no object "), F.col("object_hash")))).otherwise(F.hex("content"))
    return joined.select("manifest_hash", "ordinal", whole.alias("_h")).groupBy("manifest_hash").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "_h"))), lambda s: s["_h"]), "")).alias("content"))


def event_bytes(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(event_id, content): each event's slice of its artifact."""
    return events.join(artifacts.select(F.col("hash").alias("raw_artifact_hash"), F.col("content").alias("_c")), "raw_artifact_hash").select("event_id", F.substring("_c", F.col("byte_offset").cast("int") + 1, F.col("byte_len").cast("int")).alias("content"))


def short_refs(rows: DataFrame, key: str = "id", least: int = 4, most: int = 16) -> DataFrame:
    """(key, ref): the shortest beginning of the key's hash, of least to most digits, that no other key has; none if all are shared.

    Sorted hashes share the longest beginning with a neighbour, and those that
    differ within the first `least` digits never matter to each other: one
    shuffle of one row per key.
    """
    hashed = rows.select(key).distinct().withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_head", F.substring("_h", 1, least))
    order = Window.partitionBy("_head").orderBy("_h")

    def shared(other: Column) -> Column:
        digits = F.sequence(F.lit(least), F.lit(most))
        return F.coalesce(F.array_max(F.filter(digits, lambda n: F.substring("_h", F.lit(1), n) == F.substring(other, F.lit(1), n))), F.lit(0))

    both = hashed.withColumn("_before", F.lag("_h").over(order)).withColumn("_after", F.lead("_h").over(order))
    size = F.greatest(shared(F.col("_before")), shared(F.col("_after")), F.lit(least - 1)) + 1
    return both.withColumn("_n", size).filter(F.col("_n") <= most).select(key, F.expr("substring(_h, 1, _n)").alias("ref"))


def reassign_machine(rows: DataFrame, sources: DataFrame, machine_id: str) -> DataFrame:
    """A table whose rows of the given sources belong to a machine."""
    wanted = sources.select("source_id").distinct().withColumn("_w", F.lit(True))
    return rows.join(wanted, "source_id", "left").withColumn("machine_id", F.when(F.col("_w"), F.lit(machine_id)).otherwise(F.col("machine_id"))).select(*rows.columns)


def titled(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with titles from an index (source_kind, external_id, title, line): the last line of a session wins, blank ones do nothing."""
    last = titles.filter(F.trim("title") != "").groupBy("source_kind", "external_id").agg(F.max_by("title", "line").alias("_t"))
    return sessions.join(last, ["source_kind", "external_id"], "left").withColumn("title", F.coalesce("_t", "title")).select(*sessions.columns)


def embedding_cost(items: DataFrame, most_chars: int = 2000, overhead: int = 300) -> DataFrame:
    """(records, tokens): an estimate of a job that sends excerpts to a model."""
    return items.agg(F.count("*").alias("records"), F.floor((F.coalesce(F.sum(F.least(F.char_length("text"), F.lit(most_chars))), F.lit(0)) + F.count("*") * overhead) / 4).alias("tokens"))


def annotated(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Annotations to append: scores of 1 to 5 whose item, axis and version are new, each once; another score stops the job."""
    key = ["item_id", "axis", "annotator_version"]
    sound = F.when(F.col("score").between(1, 5), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("a score of "), F.coalesce(F.col("score").cast("string"), F.lit("null")))))
    return rows.withColumn("score", sound).dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*rows.columns)


def latest_annotations(rows: DataFrame) -> DataFrame:
    """Annotations of the version that was written last."""
    version = rows.groupBy("annotator_version").agg(F.max("annotated_at").alias("at")).orderBy(F.desc("at"), F.desc("annotator_version")).limit(1)
    return rows.join(F.broadcast(version.select("annotator_version")), "annotator_version", "left_semi")


def exportable(sessions: DataFrame, source_kinds: list[str] | None = None, scope: str | None = None, session_ids: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Sessions of an export: since looks at the latest of update, event and start; conditions that are not given choose all."""
    from sessionlake.functions import dates
    from sessionlake.operators import filters

    wanted = F.lit(True)
    if source_kinds is not None:
        wanted &= F.col("source_kind").isin(source_kinds)
    if scope is not None:
        wanted &= filters.in_scope(F.array("workspace"), scope)
    if session_ids is not None:
        wanted &= F.col("session_id").isin(session_ids)
    if since is not None:
        wanted &= F.greatest("updated_at", "last_event_at", "started_at") >= dates.since(since)
    return sessions.filter(wanted)


def freshness(files: DataFrame, checkpoints: DataFrame, sessions: DataFrame) -> DataFrame:
    """(path, raw_current, needs_workspace_refresh): whether a file was read as it is, and has a session without a workspace."""
    bare = sessions.filter("workspace is null").select("path").distinct().withColumn("_w", F.lit(True))
    read = checkpoints.select("path", F.col("cursor").alias("_c"))
    return files.join(read, "path", "left").join(bare, "path", "left").select("path", F.coalesce(F.col("_c") == F.col("cursor"), F.lit(False)).alias("raw_current"), F.coalesce("_w", F.lit(False)).alias("needs_workspace_refresh"))


def in_roots(rows: DataFrame, roots: DataFrame, path: str = "cwd") -> DataFrame:
    """Rows whose path is a root or lies under one. roots is a handful of repository folders."""
    r = F.broadcast(roots.select(F.rtrim(F.col("root"), F.lit("/")).alias("_root")))
    return rows.join(r, (F.col(path) == F.col("_root")) | F.col(path).startswith(F.concat("_root", F.lit("/"))), "left_semi")


def archive_cleanup(events: DataFrame, raw_tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Events without references to raw artifacts, and the raw tables empty."""
    return events.withColumn("raw_artifact_hash", F.lit(None).cast("string")), {name: rows.limit(0) for name, rows in raw_tables.items()}


def blob_path(hash_: Column) -> Column:
    """Where a blob of a hash lies in a store: two levels of folders by its first digits."""
    digits = F.regexp_replace(hash_, "^[^:]*:", "")
    return F.concat_ws("/", F.substring(digits, 1, 2), F.substring(digits, 3, 2), digits)


def store_blobs(blobs: DataFrame, store: str) -> DataFrame:
    """(hash, size) of the blobs (hash, content) that were written: a content-addressed store keeps each hash once, whatever is written again.

    The store is a table by the first two digits of the hash, so a look-up reads
    one folder. A content that does not have its hash stops the job. Rows that
    are there already are found by an anti-join over the folders that the new
    blobs belong to, by name alone.
    """
    spark = blobs.sparkSession
    sound = F.when(ids.content_hash(F.col("content")) == F.col("hash"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("a blob that is not "), F.coalesce("hash", F.lit("null")))))
    own = blobs.select("hash", sound.alias("content")).dropDuplicates(["hash"]).withColumn("shard", F.substring(F.regexp_replace("hash", "^[^:]*:", ""), 1, 2))
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        own = own.join(spark.read.schema("hash string, content binary, shard string").parquet(store).select("shard", "hash"), ["shard", "hash"], "left_anti")
    from sessionlake import cluster

    fresh = cluster.materialize(own.select("hash", "content", "shard"), "blobs")
    fresh.repartition("shard").write.mode("append").partitionBy("shard").parquet(store)
    return fresh.select("hash", F.octet_length("content").cast("long").alias("size"))


def work_queue(items: DataFrame, embeddings: DataFrame, model_id: str, size: int, after: dict | None = None) -> DataFrame:
    """The next `size` conversation items that need a vector, in keyset order; after: the last row of the page before, as a dictionary.

    For jobs that go on where they stopped; a bulk job takes all of
    search.missing_embeddings() at once.
    """
    from sessionlake.operators import search

    order = ["occurred_at_key", "session_id", "ordinal", "subordinal", "item_id"]
    wanted = items.filter("tier = 'conversation' and semantic_policy = 'required'")
    rows = search.missing_embeddings(wanted, embeddings, model_id).withColumn("occurred_at_key", F.coalesce(F.col("occurred_at").cast("string"), F.lit("")))
    if after is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(after[c]).cast(rows.schema[c].dataType) for c in order]))
    return rows.orderBy(*order).limit(size)


def enrichment_run(runs: DataFrame, kind: str, version: str, about: dict, created_at: str) -> DataFrame:
    """The run to append to runs (kind, version, provider, model, destination, data_scope, max_excerpt_chars, schema_description, created_at): one row, or none if it is there.

    A version belongs to one provider, model, destination, scope, excerpt and
    schema for good; other ones raise an error. Kind and version are not blank.
    """
    if not kind.strip() or not version.strip():
        raise ValueError("kind and version of an enrichment are not blank")
    names = ["provider", "model", "destination", "data_scope", "max_excerpt_chars", "schema_description"]
    stored = runs.filter((F.col("kind") == kind) & (F.col("version") == version)).first()
    if stored is not None and any(stored[n] != about[n] for n in names):
        raise ValueError(f"version {version} belongs to other metadata; choose a new one")
    row = runs.sparkSession.createDataFrame([(kind, version, *[about[n] for n in names], created_at)], "kind string, version string, provider string, model string, destination string, data_scope string, max_excerpt_chars long, schema_description string, created_at string")
    return row if stored is None else row.limit(0)


def compacted(spark: SparkSession, path: str, to: str, bytes_per_file: int = 512 << 20, order: list[str] | None = None) -> int:
    """A table's files rewritten to another folder in files of about so many bytes, optionally sorted within each; the number of files. The old folder stays."""
    table = spark.read.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    files = max(1, -(-size // bytes_per_file))
    dealt = table.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else table.repartition(files)
    dealt.write.parquet(to)
    return files


def size_preview(tables: dict[str, DataFrame], content: dict[str, str]) -> DataFrame:
    """(table, rows, bytes): how much each table's column of content holds."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(content[name])), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("table"), "rows", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


#: The order in which an import is finished; a step reads what those before it wrote.
FINAL_STEPS = ["skills", "commits", "items", "vectors", "machines"]


def finalise(steps: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Runs the given steps of FINAL_STEPS in their order, whatever the dictionary's; a name that is not among them is an error, and a step that fails ends the rest."""
    unknown = set(steps) - set(FINAL_STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    return {name: steps[name]() for name in FINAL_STEPS if name in steps}
