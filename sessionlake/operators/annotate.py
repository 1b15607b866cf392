"""Annotations of messages by a language model that the caller gives."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators import maintenance

# What a message is scored for, from 1 to 5, and the excerpt that is sent.
AXES = ["happiness", "excitement", "frustration", "satisfaction", "curiosity", "confidence", "urgency", "decisiveness", "warmth", "momentum", "playfulness"]
EXCERPT = 2000
ROWS = "item_id string, axis string, score int, model string, annotator_version string"


def parsed(answer: str, item_ids: list[str], axes: list[str]) -> dict[str, dict[str, int]]:
    """Scores of an answer: a JSON object with each item once and each axis once, all whole numbers from 1 to 5; anything else is an error."""
    found = json.loads(answer)
    if not isinstance(found, dict) or set(found) != set(item_ids):
        raise ValueError("an answer for other items")
    for item, scores in found.items():
        if not isinstance(scores, dict) or set(scores) != set(axes) or not all(type(s) is int and 1 <= s <= 5 for s in scores.values()):
            raise ValueError(f"scores of {item} that are not whole, complete and from 1 to 5")
    return found


def missing(items: DataFrame, annotations: DataFrame, version: str, axes: list[str] | None = None) -> DataFrame:
    """Items without all axes of a version, so that a stopped job goes on where it was."""
    whole = annotations.filter(F.col("annotator_version") == version).groupBy("item_id").agg(F.count_distinct("axis").alias("n")).filter(F.col("n") >= len(axes or AXES)).select("item_id")
    return items.join(whole, "item_id", "left_anti")


def annotate(items: DataFrame, ask: Callable[[list[tuple[str, str]]], str], model: str, version: str, axes: list[str] | None = None, batch: int = 20) -> DataFrame:
    """ROWS of items (item_id, text): ask gets (id, excerpt) pairs of a batch and answers JSON; an answer that is not sound stops the task."""
    wanted = axes or AXES

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                pairs = [(i, (t or "")[:EXCERPT]) for i, t in zip(part["item_id"], part["text"])]
                scores = parsed(ask(pairs), [i for i, _ in pairs], wanted)
                yield pd.DataFrame([(i, a, s, model, version) for i, own in scores.items() for a, s in own.items()], columns=[c.split()[0] for c in ROWS.split(", ")])

    return items.select("item_id", "text").mapInPandas(work, ROWS)


def without_version(rows: DataFrame, version: str) -> DataFrame:
    return rows.filter(F.col("annotator_version") != version)


def counters(items: DataFrame, annotations: DataFrame, version: str, axes: list[str] | None = None) -> DataFrame:
    """(corpus, complete, rows_written)."""
    own = annotations.filter(F.col("annotator_version") == version)
    left = missing(items, annotations, version, axes).count()
    return items.agg(F.count("*").alias("corpus")).withColumn("complete", F.col("corpus") - left).crossJoin(F.broadcast(own.agg(F.count("*").alias("rows_written"))))


preflight = maintenance.embedding_cost
