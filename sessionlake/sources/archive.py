"""The interchange archive: JSON lines of envelopes, checked as they are read, and written again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import maintenance

SCHEMAS = ["sessionlake.archive.v1", "sessionlake.archive.v2"]
ENVELOPE = "schema string, id string, hash string, producer string, produced_at timestamp, kind string, payload string"
# The kinds of records with their fields.
KINDS = {
    "source": "id string, kind string, identity string, path string, first_seen_at timestamp, updated_at timestamp, hash string",
    "machine": "id string, name string, hash string",
    "session": "id string, source_id string, machine_id string, source_kind string, external_id string, title string, status string, started_at timestamp, updated_at timestamp, metadata string, hash string",
    "event": "id string, session_id string, source_id string, machine_id string, source_kind string, ordinal long, event_type string, role string, content string, raw_artifact_hash string, occurred_at timestamp, metadata string, hash string",
    "search_unit": "id string, event_id string, session_id string, source_id string, machine_id string, source_kind string, role string, search_kind string, text string, text_hash string, occurred_at timestamp, metadata string, hash string",
    "embedding": "id string, unit_id string, text_hash string, model_id string, dims int, vector_hash string, vector string, producer_machine_id string, embedded_at timestamp, metadata string, hash string",
    "raw_artifact": "hash string, source_id string, path string, size long, mtime_ms long, media_type string, content string, first_seen_at timestamp",
}


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound envelopes, rejected lines with a reason)."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("e", F.from_json("value", ENVELOPE))
    own = F.coalesce(F.get_json_object("e.payload", "$.id"), F.get_json_object("e.payload", "$.hash"))
    reason = (
        F.when(F.col("e.schema").isNull(), "no envelope")
        .when(~F.col("e.schema").isin(SCHEMAS), "schema")
        .when(~F.coalesce(F.col("e.kind").isin(list(KINDS)), F.lit(False)), "kind")
        .when(~F.coalesce(own == F.col("e.id"), F.lit(False)), "id")
        .when(~F.coalesce(F.get_json_object("e.payload", "$.hash") == F.col("e.hash"), F.lit(False)), "hash")
    )
    judged = lines.withColumn("reason", reason)
    return judged.filter("reason is null").select("e.*"), judged.filter("reason is not null").select("value", "reason")


def records(envelopes: DataFrame, kind: str) -> DataFrame:
    return envelopes.filter(F.col("kind") == kind).select(F.from_json("payload", KINDS[kind]).alias("p")).select("p.*")


def write(tables: dict[str, DataFrame], path: str, producer: str, produced_at: str) -> None:
    """Records of tables by kind as lines of envelopes."""
    out = None
    for kind, rows in tables.items():
        lines = maintenance.envelopes(rows, kind, SCHEMAS[-1], producer, produced_at)
        out = lines if out is None else out.union(lines)
    if out is not None:
        out.write.text(path)


def vectors(embeddings: DataFrame) -> DataFrame:
    """Embeddings with their vectors decoded from base64 of little-endian floats."""
    def decode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield frame.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return embeddings.withColumn("embedding", F.pandas_udf(decode, "array<float>")(F.unbase64("vector")))


def spill(spark: SparkSession, stream: Iterable[bytes], folder: str, file_bytes: int = 64 << 20) -> int:
    """Writes the lines of a stream, such as standard input, to files of a folder; how many lines there were.

    One file's lines are held at most. A file takes its name when it is whole,
    so a reader of the folder, read() or a stream of its lines, never sees a part
    of one, and whoever reads may be slower than whoever writes.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(folder))
    number = lines = size = 0
    held: list[bytes] = []

    def write() -> None:
        nonlocal number, size
        part = hadoop(f"{folder}/_part-{number:06d}")
        out = fs.create(part, True)
        out.write(bytearray(b"".join(held)))
        out.close()
        fs.rename(part, hadoop(f"{folder}/part-{number:06d}.jsonl"))
        held.clear()
        number, size = number + 1, 0

    for line in stream:
        line = line if line.endswith(b"\n") else line + b"\n"
        held.append(line)
        lines, size = lines + 1, size + len(line)
        if size >= file_bytes:
            write()
    if held:
        write()
    return lines
