"""Connected components: contraction within tasks, then alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import cluster

#: Edges that one task contracts at once, about. Fewer edges in all than this need no rounds.
TASK_EDGES = 1_000_000


def labels_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over edges (u, v), by hooking and pointer jumping on whole arrays."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        for end in (u, v):
            np.minimum.at(label, label[end], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, least node that this task's edges lead to) in place of a task's edges."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    both = pa.concat_arrays([*table.column("u").chunks, *table.column("v").chunks])
    names = both.unique()
    names = names.take(pc.sort_indices(names))
    code = pc.index_in(both, names).to_numpy()
    label = labels_of(code[: table.num_rows], code[table.num_rows :], len(names))
    own = np.flatnonzero(label != np.arange(len(names)))
    yield from pa.table({"u": names.take(pa.array(own)), "v": names.take(pa.array(label[own]))}).to_batches()


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label) of each node of the edges (a, b), both strings or both numbers; label is the least node that it reaches.

    Loops and repeated edges change nothing; edges with a null end are left
    out; no edges, no rows.

    Each task first puts a forest in place of its share of the edges, about
    task_edges of them. If one task holds all, that is the answer. Else rounds
    follow that keep the components and bring every node closer to the least one
    of its own, in a number that grows with the logarithm of the nodes; each is
    written to the shared folder and the one before is deleted. Rounds end when
    nothing changes. A large component ends as a star, whose middle is one key
    of the joins: rows of two nodes, which the skew join of AQE splits;
    groupings and distinct combine before they shuffle.
    """
    raw = cluster.materialize(edges.selectExpr("greatest(a, b) u", "least(a, b) v").filter("a is not null and b is not null and u <> v").distinct(), "edges")
    parts = -(-raw.count() // task_edges)
    held = cluster.materialize(raw.repartition(max(1, parts)).mapInArrow(_contracted, raw.schema), "edges")
    cluster.discard(raw)
    before = None
    for _ in range(most_rounds if parts > 1 else 0):
        both = held.union(held.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        past, held = held, cluster.materialize(small, "edges")
        cluster.discard(past)
        now = tuple(held.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return held.selectExpr("u as node", "v as label").union(held.selectExpr("v", "v").distinct())
