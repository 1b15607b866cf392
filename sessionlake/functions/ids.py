"""Deterministic identities by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def stable_id(*parts: Column) -> Column:
    """A hash over parts, each ended by a zero; null if a part is null, so that no two part lists fall together."""
    joined = F.concat(*[F.concat(p.cast("string"), F.lit("\0")) for p in parts])
    return F.concat(F.lit("sc_"), F.sha2(joined, 256))


def record_hash(*columns: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
