"""Packing documents into fixed windows by non-negative least squares.

A document's ids are cut into whole windows and a remainder. Remainders are
counted by length class in one histogram. All combinations of at most DEPTH
classes that fill a window exactly are enumerated; non-negative least squares
finds how often to use each so that together they use up the histogram; the
counts are rounded down, and what rounding leaves is used up by the same
combinations one after the other. What no combination takes is packed best-fit,
longest first, in shards.

Only the histogram (one number per class) comes to the driver. A piece finds its
place by its rank within its class, which is its rank within a bucket of the
class plus the sizes of the buckets before it, so a class that holds a third of
all pieces is ranked by many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import bpe, columns

WINDOW = 2048
#: Tokens of a length class, and classes that a combination holds at most.
UNIT, DEPTH = 8, 4
#: Pieces that one bucket of ranks or one shard of residuals holds, about.
SHARD = 50_000
#: The id that ends every document.
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """The ids of a tokenizer file of byte-level BPE (vocabulary, merges, added tokens), added tokens inside texts included.

    tiktoken encodes by the file's vocabulary as ranks. Its regular expression
    gives up on very long white space and its merging is slow on very long
    words, so texts with a run of RUN characters of either go through
    bpe.Vocabulary, which scans arrays and follows the file's merges.
    """

    RUN = 5_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.path, self.added = path, added
        ranks = {data: i for i, data in bpe.token_bytes(whole["model"]["vocab"]).items() if i not in added.values()}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.long = re.compile(rf"(?<!\s)\s{{{self.RUN}}}|(?<!\S)\S{{{self.RUN}}}")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < self.RUN or not self.long.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        slow = bpe.vocabulary("merges", self.path)
        parts = [p for p in (self.split.split(text) if self.split else [text]) if p]
        return np.concatenate([np.array([self.added[p]], "<u4") if p in self.added else np.frombuffer(slow.encode([p])[0], "<u4") for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """An encoder, made once in each Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each row's ids and END_ID, cut into windows and a remainder: one row per piece, with a checksum in place of its ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, texts in columns.slices(batch, "text"):
                rows = []
                for key, own in zip(keys[start:], texts):
                    ids = np.append(encode(own), END_ID).astype("<u4")
                    rows += [(key, at, min(window, len(ids) - at), zlib.crc32(ids[at : at + window].tobytes()), len(ids)) for at in range(0, len(ids), window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, PIECES)


def _parts(total: int, size: int, least: int) -> np.ndarray:
    """All ascending rows of size numbers of at least `least` with the given total."""
    if size == 1:
        return np.array([[total]]) if total >= least else np.zeros((0, 1), int)
    if size == 2:
        first = np.arange(least, total // 2 + 1)
        return np.column_stack([first, total - first])
    rows = [np.insert(_parts(total - k, size - 1, k), 0, k, axis=1) for k in range(least, total // size + 1)]
    return np.concatenate(rows) if rows else np.zeros((0, size), int)


def combinations(total: int, depth: int) -> np.ndarray:
    """All multisets of at most depth positive numbers with the given total, ascending, padded with zeros in front."""
    return np.concatenate([np.pad(_parts(total, size, 1), ((0, 0), (depth - size, 0))) for size in range(1, depth + 1)])


def nnls(members: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, where column j of A counts the entries of members[j]; entry 0 stands for nothing.

    An active-set method: the column that would lessen the error most joins the
    free ones, their least squares are solved anew, and columns that this would
    push below zero leave.
    """
    rows, scale = len(target), max(1.0, float(target.max()))
    h = target / scale
    x = np.zeros(len(members))
    free: list[int] = []
    dense = np.zeros((rows, 0))

    def column(j: int) -> np.ndarray:
        return np.bincount(members[j], minlength=rows).astype(float) * (np.arange(rows) > 0)

    for _ in range(3 * rows):
        error = h - dense @ x[free]
        error[0] = 0
        gain = error[members].sum(axis=1)
        gain[free] = 0
        best = int(gain.argmax())
        if gain[best] <= 1e-7:
            break
        free.append(best)
        dense = np.column_stack([dense, column(best)])
        while True:
            solved = np.linalg.solve(dense.T @ dense + 1e-10 * np.eye(len(free)), dense.T @ h)
            if (solved > 0).all():
                x[free] = solved
                break
            now = x[free]
            falls = solved <= 0
            step = (now[falls] / np.maximum(now[falls] - solved[falls], 1e-300)).min()
            now = now + step * (solved - now)
            keep = now > 1e-12
            keep &= ~(falls & (now <= 1e-9))
            x[free] = 0
            free = [j for j, k in zip(free, keep) if k]
            dense = dense[:, keep]
            x[free] = now[keep]
            if not free:
                break
    return x * scale


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a window, how many windows), never more than the histogram has; entry k counts the pieces of class k."""
    total = len(histogram) - 1
    members = combinations(total, depth)
    members = members[(histogram[members[:, -1]] > 0) & ((histogram[members] > 0) | (members == 0)).all(axis=1)]
    if not len(members):
        return []
    repeats = np.floor(nnls(members, histogram.astype(float)) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    used: dict[tuple[int, ...], int] = {}

    def take(j: int, most: int | None) -> None:
        own = [int(k) for k in members[j] if k]
        need = {k: own.count(k) for k in own}
        count = min(int(left[k]) // n for k, n in need.items())
        count = count if most is None else min(count, most)
        if count > 0:
            for k, n in need.items():
                left[k] -= n * count
            used[tuple(own)] = used.get(tuple(own), 0) + count

    for j in np.argsort(-repeats, kind="stable").tolist():
        if not repeats[j]:
            break
        take(j, int(repeats[j]))
    for j in np.lexsort(members.T).tolist()[::-1]:  # those with the longest pieces first
        if left[members[j, -1]]:
            take(j, None)
    return sorted(used.items())


def _best_fit(pieces: pd.DataFrame, window: int) -> pd.DataFrame:
    """Best fit, longest first: a piece goes where it leaves least room. Adds a shard's own sequence numbers and slots."""
    pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    room: list[list[int]] = [[] for _ in range(window + 1)]
    mask, opened, sequence, slot = 0, 0, [], []
    filled: list[int] = []
    for length in pieces["length"].tolist():
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free, own, opened = window, opened, opened + 1
            filled.append(0)
        rest = free - length
        if rest:
            room[rest].append(own)
            mask |= 1 << rest
        sequence.append(own)
        slot.append(filled[own])
        filled[own] += 1
    return pieces.assign(local=sequence, slot=slot)


PACKED = f"{PIECES}, sequence_id long, slot long"


def pack(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """(piece's columns, sequence_id, offset) of every piece of PIECES; a sequence holds at most window ids, without gaps from offset 0.

    Pieces that repeat are packed each for itself. A null doc_id is kept. An
    empty table gives no rows. pieces is read three times; write it first.
    """
    classed = pieces.withColumn("cls", F.ceil(F.col("length") / unit).cast("int")).withColumn("cls", F.when(F.col("length") == window, window // unit + 1).otherwise(F.col("cls")))
    most = window // unit
    by_class = {r["cls"]: r["count"] for r in classed.groupBy("cls").count().collect()}  # one row per class
    total = sum(by_class.values())
    histogram = np.zeros(most + 1, np.int64)
    for k, n in by_class.items():
        if k <= most:
            histogram[k] = n
    chosen = plan(histogram, depth)
    whole_base = sum(n for _, n in chosen)
    rest_base = whole_base + by_class.get(most + 1, 0)
    # slots of each class: where a strategy's ranks begin, its pieces of the class, its first sequence, and the slot of the first of them
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    reached: dict[int, int] = {}
    base = 0
    for own, n in chosen:
        for k in sorted(set(own)):
            slots.setdefault(k, []).append((reached.get(k, 0), own.count(k), base, own.index(k)))
            reached[k] = reached.get(k, 0) + own.count(k) * n
        base += n
    tables = {k: np.array(v, np.int64) for k, v in slots.items()}

    buckets = max(1, -(-total // shard))
    dealt = classed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("cls", "bucket").count()
    before = sizes.select("cls", "bucket", (F.sum("count").over(Window.partitionBy("cls").orderBy("bucket")) - F.col("count")).alias("before"))
    order = Window.partitionBy("cls", "bucket").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("own", F.row_number().over(order)).join(before, ["cls", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            cls, rank = frame.column("cls").to_numpy(), frame.column("rank").to_numpy()
            sequence, slot = np.full(len(cls), -1, np.int64), np.zeros(len(cls), np.int64)
            full = cls == most + 1
            sequence[full] = whole_base + rank[full]
            for k in np.unique(cls[~full]).tolist():
                own = np.flatnonzero((cls == k) & (rank < reached.get(k, 0)))
                if len(own):
                    table = tables[k]
                    row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                    within = rank[own] - row[:, 0]
                    sequence[own] = row[:, 2] + within // row[:, 1]
                    slot[own] = row[:, 3] + within % row[:, 1]
            out = frame.select([c.split()[0] for c in PIECES.split(", ")])
            yield from out.append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot)).to_batches()

    names = [c.split()[0] for c in PIECES.split(", ")]
    placed = cluster.materialize(ranked.select(*names, "cls", "rank").mapInArrow(place, PACKED), "packed")
    rest = placed.filter("sequence_id < 0")
    left = sum(by_class.values()) - sum(reached.values()) - by_class.get(most + 1, 0)
    shards = max(1, -(-left // shard))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        out = _best_fit(group, window)
        out["sequence_id"] = rest_base + out["local"] * shards + out["shard"]
        return out[[*names, "sequence_id", "slot"]]

    fitted = rest.withColumn("shard", F.pmod(F.xxhash64("start", "doc_id", "ids_crc32"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(fit, PACKED)
    every = placed.filter("sequence_id >= 0").unionByName(fitted)
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot")
    return every.withColumn("offset", (F.sum("length").over(in_sequence) - F.col("length")).cast("long")).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut and pack every row's whole text by a tokenizer file (path).

    A null text is empty and is one piece of END_ID alone. Rows that repeat, and
    rows with a null id, are documents each for itself. Other columns are left
    out; an empty table gives no rows.
    """
    return pack(cluster.materialize(cut(docs, path, doc_id, text), "pieces"))
