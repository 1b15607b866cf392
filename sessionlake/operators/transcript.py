"""Markdown of a session; the rows of one session come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators import sequences


def render(items: DataFrame, session_id: str, target: str | None = None, before: int | None = None, after: int | None = None, full: bool = False, preview: int = 200) -> str:
    """A transcript: all of a session or what is around a target, which is marked; neighbours are cut short unless full."""
    own = items.filter(F.col("session_id") == session_id)
    if not full:
        own = own.filter("tier = 'conversation'")
    if target is not None and before is not None and after is not None:
        own = sequences.context(own, "session_id", ["ordinal", "item_id"], F.col("item_id") == target, before, after)
    lines = []
    for row in own.orderBy("ordinal", "item_id").collect():
        mark = "▶ " if row["item_id"] == target else ""
        text = row["text"] or ""
        if target is not None and row["item_id"] != target and len(text) > preview:
            text = text[:preview] + "..."
        when = f" — {row['occurred_at']:%Y-%m-%d %H:%M}" if row["occurred_at"] else ""
        lines.append(f"## {mark}{row['kind']}{when}\n\n{text}\n")
    return f"# Session {session_id}\n\n" + "\n".join(lines)
