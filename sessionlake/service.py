"""The calls of a local service as functions with JSON answers: success and data, or an error and its kind."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators import lookups, maintenance, postings, search, sequences, transcript
from sessionlake.sources import archive


def answer(call: Callable[[], object]) -> str:
    """A call's result in an envelope; an error becomes one too."""
    try:
        return json.dumps({"ok": True, "data": call()}, default=str, ensure_ascii=False)
    except (LookupError, ValueError) as why:
        return json.dumps({"ok": False, "error": {"kind": type(why).__name__, "message": str(why)}}, ensure_ascii=False)


@dataclass
class Service:
    """Over the tables of one store. index: a postings.Index of the items; without one, which is for small stores, searches scan them."""

    sessions: DataFrame
    items: DataFrame
    index: postings.Index | None = None
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def health(self) -> str:
        return answer(lambda: {"sessions": self.sessions.count(), "items": self.items.count(), "vectors": self.vectors is not None})

    def heads(self, limit: int = 50) -> str:
        return answer(lambda: self._rows(self.sessions.orderBy(F.desc_nulls_last("last_event_at"), F.desc("session_id")).limit(limit)))

    def search(self, query: str, limit: int = 25, sort: str = "relevance", recency: float = 0.0, as_of: str | None = None) -> str:
        def call() -> object:
            if limit < 1:
                raise ValueError("limit is at least 1")
            wanted = self.embed(search.expanded(query)) if self.embed else None
            found, reason = search.hybrid(self.items, self.vectors, query, wanted, limit, sort, recency, as_of, index=self.index)
            return {"results": self._rows(found), "semantic_unavailable": reason}

        return answer(call)

    def show(self, item_id: str, before: int = 3, after: int = 5) -> str:
        def call() -> object:
            target = lookups.by_id(self.items, "item_id", item_id).first()
            if target is None:
                raise LookupError(f"no item {item_id}")
            own = lookups.conversation(self.items.withColumn("subordinal", F.lit(0)), target["session_id"])
            return self._rows(sequences.context(own, "session_id", ["ordinal", "item_id"], F.col("ordinal") >= target["ordinal"], before, after).orderBy("place"))

        return answer(call)

    def transcript(self, session_id: str, target: str | None = None, full: bool = False, before: int | None = None, after: int | None = None) -> str:
        """A session's Markdown, whole or, with before and after, around a target item."""

        def call() -> object:
            if not lookups.by_id(self.sessions, "session_id", session_id).limit(1).count():
                raise LookupError(f"no session {session_id}")
            return transcript.render(self.items, session_id, target, before, after, full=full)

        return answer(call)

    def export(self, path: str, tables: dict[str, DataFrame], producer: str, produced_at: str, session_ids: list[str] | None = None) -> str:
        """Writes tables by kind as an archive; of chosen sessions only the rows that they depend on. How many rows of each kind."""

        def call() -> object:
            chosen = tables
            if session_ids is not None:
                keys = {"session": "id", "event": "session_id", "search_unit": "session_id"}
                wanted = F.col
                chosen = {kind: rows.filter(wanted(keys[kind]).isin(session_ids)) for kind, rows in tables.items() if kind in keys}
                own = chosen["session"].select(F.col("source_id").alias("_s"), F.col("machine_id").alias("_m"))
                for kind, key in (("source", "_s"), ("machine", "_m")):
                    if kind in tables:
                        chosen[kind] = tables[kind].join(own.select(F.col(key).alias("id")).distinct(), "id", "left_semi").select(*tables[kind].columns)
            archive.write(chosen, path, producer, produced_at)
            return {kind: rows.count() for kind, rows in chosen.items()}

        return answer(call)

    def importing(self, path: str, stored: dict[str, DataFrame]) -> str:
        """What an archive would add to stored tables (id, hash) by kind: inserted, duplicates and conflicts, and how many lines are no records."""

        def call() -> object:
            sound, rejected = archive.read(self.sessions.sparkSession, path)
            told = {kind: maintenance.import_records(held, archive.records(sound, kind))[1].first().asDict() for kind, held in stored.items()}
            return {"records": told, "rejected": rejected.count()}

        return answer(call)
