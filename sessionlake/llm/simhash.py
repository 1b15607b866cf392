"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison inside buckets, components of the links.

Two fingerprints that differ in at most `radius` bits agree in all but `radius`
of `blocks` equal blocks, so each fingerprint goes into one bucket per choice of
the other blocks. Inside a bucket the fingerprints lie as 64 bit planes; a lag d
compares every lane with the lane d places further on at once: planes are XORed
with themselves shifted, and carry-save counters, preset so that they overflow
just beyond the radius, add up the differing bits. A block of lanes is abandoned
once all its lanes have overflowed. A bucket yields a spanning forest of its
links, never its pairs.

Only distinct fingerprints enter, so copies cost nothing. A bucket of more than
HEAVY fingerprints is dealt anew by its remaining bits, cut into blocks in the
same way; what then falls together differs in so few bits that a bucket cannot
outgrow 2 to the power of those. Components are those of operators.graphs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import columns
from sessionlake.operators import graphs

BITS, SEED, WORDS, RADIUS = 64, 42, 3, 2
#: Buckets of more fingerprints are split by their other bits.
HEAVY = 1 << 16
#: Shingles whose bits are counted at once, and bytes of a text that are split into words at once.
CHUNK_SHINGLES, CHUNK_BYTES = 400_000, 8_000_000
#: Lanes of a block that is abandoned as a whole.
LANES = 512

_WHITE = b" \t\n\x0b\x0c\r"


def _word_runs(data: bytes, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in runs, cut at white space."""
    if len(data) <= most:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = min(len(data), start + most)
        while end < len(data) and data[end] not in _WHITE:
            end += 1
        yield data[start:end].split()
        start = end


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in runs. Fewer words than a shingle has make one; no words make none."""
    digest, tail, found = partial(xxhash.xxh64_intdigest, seed=seed), [], False
    for run in _word_runs(text.encode("utf-8", "replace").lower()):
        run = tail + run
        if len(run) >= words:
            found = True
            shingles = map(b" ".join, zip(*(run[k:] for k in range(words))))
            yield np.fromiter(map(digest, shingles), np.uint64, len(run) - words + 1)
        tail = run[-(words - 1) :] if words > 1 else []
    if tail and not found:
        yield np.array([digest(b" ".join(tail))], np.uint64)


def _bit_counts(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    """How often each bit is set in each run of hashes: (runs, 64)."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = [*starts[1:], len(hashes)]
    return np.array([bits[a:b].sum(axis=0, dtype=np.uint32) for a, b in zip(starts, ends)], np.int64).reshape(-1, BITS)


def fingerprints_of(runs: Iterator[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """The fingerprints of n texts from runs (text, hashes) of their shingles: a bit is set if over half of a text's hashes have it; without any, zero."""
    counts, totals = np.zeros((n, BITS), np.int64), np.zeros(n, np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]]).tolist()
            np.add.at(counts, owners, _bit_counts(np.concatenate(held), starts))
            np.add.at(totals, owners, [len(h) for h in held])
        held.clear(), owners.clear()
        size = 0

    for k, hashes in runs:
        for at in range(0, len(hashes), CHUNK_SHINGLES):
            held.append(hashes[at : at + CHUNK_SHINGLES])
            owners.append(k)
            size += len(held[-1])
            if size >= CHUNK_SHINGLES:
                flush()
    flush()
    return np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_texts(texts: list[str], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprints of texts over their word shingles, repeats included."""
    return fingerprints_of(((k, hashes) for k, text in enumerate(texts) for hashes in shingle_hashes(text, words, seed)), len(texts))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long with the fingerprint's bits. A null text is empty and has fingerprint zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in columns.slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(texts)), "fp": pa.array(fingerprint_texts(texts, words, seed).view(np.int64))})

    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(work, "doc_id long, fp long")


def _edges(bits: int, parts: int) -> list[tuple[int, int]]:
    cuts = [bits * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _keys(fps: np.ndarray, radius: int, blocks: int, positions: list[int]) -> Iterator[np.ndarray]:
    """For each choice of blocks - radius blocks of the given bit positions, a number that equals for fingerprints that agree there."""
    for choice in combinations(_edges(len(positions), blocks), blocks - radius):
        key = np.zeros(len(fps), np.uint64)
        for k, bit in enumerate(positions[i] for a, b in choice for i in range(a, b)):
            key |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        yield key


def _blocks_for(radius: int) -> int:
    return radius + 2


def near_lanes(fps: np.ndarray, same: np.ndarray, lag: int, planes: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes i for which fps[i] and fps[i + lag] differ in at most radius bits, among those with same[i].

    planes[s] are the bit planes packed from lane s on, so that a lag is a shift by whole bytes of one of them.
    """
    n = len(fps) - lag
    size = -(-n // 8)
    left, right = planes[0][:, :size], planes[lag % 8][:, lag // 8 : lag // 8 + size]
    width = LANES // 8
    rows = -(-size // width)

    def blocked(x: np.ndarray) -> np.ndarray:
        out = np.zeros(rows * width, np.uint8)
        out[: x.shape[0]] = x
        return out.reshape(rows, width)

    over = ~blocked(np.packbits(same[:n], bitorder="little"))
    alive = np.flatnonzero((over != 255).any(axis=1))
    over = over[alive]
    counters = radius.bit_length()
    preset = (1 << counters) - 1 - radius
    count = [np.full(over.shape, 255 if preset >> k & 1 else 0, np.uint8) for k in range(counters)]
    for plane in range(BITS):
        if not len(alive):
            return np.zeros(0, np.int64)
        carry = (blocked(left[plane]) ^ blocked(right[plane]))[alive] if len(alive) * 4 > rows else _some(left[plane], alive, width) ^ _some(right[plane], alive, width)
        for k in range(counters):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if plane % 4 == 3:
            keep = (over != 255).any(axis=1)
            if not keep.all():
                alive, over, count = alive[keep], over[keep], [c[keep] for c in count]
    row, lane = np.nonzero(np.unpackbits(~over, axis=1, bitorder="little"))
    return alive[row] * LANES + lane


def _some(plane: np.ndarray, alive: np.ndarray, width: int) -> np.ndarray:
    at = alive[:, None] * width + np.arange(width)
    return np.where(at < len(plane), plane[np.minimum(at, len(plane) - 1)], 0).astype(np.uint8)


def forest(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within runs of equal keys, each of two fingerprints that differ in at most radius bits; together they reach what all links of a run reach."""
    label = np.arange(len(fps))
    parent = label.tolist()
    left: list[int] = []
    right: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    least = 2
    while len(sizes) and least <= sizes.max():  # runs of alike sizes together
        chosen = np.flatnonzero((sizes >= least) & (sizes < 4 * least))
        if len(chosen):
            rows = np.concatenate([np.arange(starts[c], starts[c] + sizes[c]) for c in chosen.tolist()])
            own, key = fps[rows], keys[rows]
            bits = np.ascontiguousarray(np.unpackbits(np.ascontiguousarray(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)
            planes = [np.packbits(bits[:, s:], axis=1, bitorder="little") for s in range(8)]
            for lag in range(1, int(sizes[chosen].max())):
                same = key[:-lag] == key[lag:]
                same &= label[rows[:-lag]] != label[rows[lag:]]
                near = near_lanes(own, same, lag, planes, radius) if same.any() else ()
                if len(near):
                    for x, y in zip(rows[near].tolist(), rows[near + lag].tolist()):
                        a, b = root(x), root(y)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            left.append(x), right.append(y)
                    label[rows] = [root(x) for x in rows.tolist()]
        least *= 4
    signed = fps.view(np.int64)
    return signed[np.array(left, np.int64)], signed[np.array(right, np.int64)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, fingerprints) of rows that come sorted by key, cut between keys only."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            yield keys[:whole], fps[:whole]
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield keys, fps


def links(nodes: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): a forest for each bucket whose components, over all buckets, are those of all links."""
    blocks = _blocks_for(radius)
    choices = list(combinations(_edges(BITS, blocks), blocks - radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for k, key in enumerate(_keys(own, radius, blocks, list(range(BITS)))):
                mixed = ((key ^ np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)) if len(own) else key
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(mixed.view(np.int64)), "fp": pa.array(own.view(np.int64))})

    # a key of radius 2 has 32 bits, so numbering the choice at bit 40 keeps buckets apart; with longer keys buckets may fall together, which adds comparisons and no links
    dealt = nodes.select("fp").mapInArrow(deal, "bucket long, fp long")
    large = dealt.groupBy("bucket").count().filter(F.col("count") > heavy).select("bucket", F.lit(True).alias("large"))
    marked = dealt.join(large, "bucket", "left")

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, own, large_ = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            out_key, out_fp = [bucket[~large_]], [own[~large_]]
            if large_.any():
                own, bucket = own[large_], bucket[large_]
                for k, choice in enumerate(choices):
                    free = [b for b in range(BITS) if not any(x <= b < y for x, y in choice)]
                    for j, key in enumerate(_keys(own, radius, blocks, free)):
                        out_key.append((bucket + np.uint64(1 + k)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (key ^ np.uint64(j << 40)) * np.uint64(0x9E3779B97F4A7C15))
                        out_fp.append(own)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.concatenate(out_key).view(np.int64)), "fp": pa.array(np.concatenate(out_fp).view(np.int64))})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _runs(batches):
            a, b = forest(keys, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    split = marked.select("bucket", "fp", "large").mapInArrow(deal_again, "bucket long, fp long")
    return split.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach, its own included.

    A null or empty text has fingerprint zero, linked like any other. Rows that
    repeat, or share a text, are in one component. A null doc_id stays null and
    is in a component by its text. Other columns are left out; an empty table
    gives no rows. Fingerprints are written to the shared folder, as they are
    needed three times.
    """
    rows = cluster.materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = graphs.components(links(nodes, radius))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    own = named.select("fp", "label").join(lowest, "label").select("fp", "component_id")
    return rows.join(own, "fp").select("doc_id", "fp", "component_id")
