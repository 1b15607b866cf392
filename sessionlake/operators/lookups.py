"""Point look-ups, probes and health checks over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of one id; on a table that is partitioned or sorted by it, a pruned read."""
    return rows.filter(F.col(key) == value)


def by_external_id(sessions: DataFrame, external_id: str) -> DataFrame:
    """Sessions of an external id, of which there may be several, by kind and id."""
    return sessions.filter(F.col("external_id") == external_id).orderBy("source_kind", "session_id")


def by_native_suffix(sessions: DataFrame, native_id: str) -> DataFrame:
    """pi_agent and omp sessions whose external id ends in _ and the native id."""
    return sessions.filter(F.col("source_kind").isin("pi_agent", "omp") & F.col("external_id").endswith(f"_{native_id}")).orderBy("source_kind", "session_id")


def conversation(items: DataFrame, session_id: str) -> DataFrame:
    return items.filter((F.col("session_id") == session_id) & (F.col("tier") == "conversation")).orderBy("ordinal", "subordinal", "item_id")


def latest_external_id(sessions: DataFrame) -> DataFrame:
    """(path, external_id) of the session of each path that was touched last."""
    return sessions.groupBy("path").agg(F.max_by("external_id", F.struct(F.coalesce("updated_at", "started_at"), "session_id")).alias("external_id"))


def events_of_hash(events: DataFrame) -> DataFrame:
    """(hash, event_ids): events with one content."""
    return events.groupBy("hash").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"))


def foreign_sources(sessions: DataFrame, machine_id: str) -> DataFrame:
    """Sources with a session of another machine."""
    return sessions.filter(F.col("machine_id") != machine_id).select("source_id").distinct()


def unlabeled(topics: DataFrame, labels: DataFrame, labeler: str) -> DataFrame:
    return topics.join(labels.filter(F.col("labeler_version") == labeler), ["version", "topic_id"], "left_anti")


def any_missing(wanted: DataFrame, have: DataFrame, on: list[str]) -> bool:
    """Whether a wanted row is not there; the search ends with the first."""
    return bool(wanted.join(have, on, "left_anti").limit(1).count())


def history_health(events: DataFrame, items: DataFrame) -> DataFrame:
    """(ready, missing): conversation events without an item."""
    wanted = events.filter(F.col("role").isin("user", "assistant") & (F.trim("content") != "")).select("event_id")
    return wanted.join(items.filter("tier = 'conversation'").select("event_id"), "event_id", "left_anti").agg((F.count("*") == 0).alias("ready"), F.count("*").alias("missing"))


def index_health(units: DataFrame, indexed: DataFrame, indexable: DataFrame) -> DataFrame:
    """(units, indexed, indexable, sound): counts that agree if the text index is whole."""
    counts = units.agg(F.count("*").alias("units")).crossJoin(F.broadcast(indexed.agg(F.count("*").alias("indexed")))).crossJoin(F.broadcast(indexable.agg(F.count("*").alias("indexable"))))
    return counts.withColumn("sound", (F.col("units") == F.col("indexed")) & (F.col("units") == F.col("indexable")))


def status(counts: dict[str, DataFrame]) -> DataFrame:
    """(source_kind, a count per table) from tables with a source_kind."""
    out = None
    for name, rows in counts.items():
        one = rows.groupBy("source_kind").agg(F.count("*").alias("n")).select("source_kind", *[(F.col("n") if other == name else F.lit(0).cast("long")).alias(other) for other in counts])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source_kind").agg(*[F.sum(name).alias(name) for name in counts])
