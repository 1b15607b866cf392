"""Nearest neighbours by collision counting over single-projection sorted arrays.

Each shard of the vectors keeps, for every one of M random directions, its
vectors in the order of their projections. A query opens a window around its own
projection in every array; widening all windows together is the same as hashing
anew with larger buckets (virtual rehashing). A vector that stands in at least
`threshold` of the windows is verified by its cosine. Windows widen until they
belong to a distance that the k-th verified vector has already, so that a vector
nearer than it has most likely been counted.

A query is first asked of one shard. The distance of its k-th neighbour there
bounds the windows that it opens, once, in the other shards.

Nothing is cut short: every vector that reaches the threshold is verified, and
if fewer than k do so at the widest windows, all of the shard's are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake import cluster

#: Directions, vectors of a shard (a place in it fits 16 bits), and the seed of the directions.
M, SHARD, SEED = 128, 16_384, 11
#: A window's half-width for distance R is R times the spread of one direction; a vector at R is in it with this chance.
CHANCE = math.erf(1 / math.sqrt(2))
#: Standard deviations below the expected number of collisions at which the threshold lies; directions that are orthogonal vary less.
SLACK = 1.0
FIRST_RADIUS, GROWTH = 0.5, 1.5


def directions(dim: int, m: int = M, seed: int = SEED) -> np.ndarray:
    """m unit directions in columns; each run of dim of them is orthogonal."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))], axis=1)[:, :m]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision; sums are exactly rounded, so equal vectors have equal scores wherever they are."""
    return max(-1.0, min(1.0, math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist())) / math.sqrt(math.fsum((b * b).tolist()))))


def _firsts(group: np.ndarray, most: int) -> np.ndarray:
    """Rows that are among the first `most` of their group, in order."""
    by_group = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(group[by_group]) > 0)) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    return np.sort(by_group[place < most])


class Index:
    """Sorted projections of one shard's vectors. A row that repeats counts once; of equal vectors only the k + 1 with the least ids are kept, as no answer has more of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, m: int = M):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
        same = lambda rows: np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
        keep = _firsts(same(np.ascontiguousarray(np.column_stack([ids.view(np.float64), vectors]))), 1)
        ids, vectors = ids[keep], np.ascontiguousarray(vectors[keep])
        keep = _firsts(same(vectors), k + 1)
        self.ids, self.vectors = ids[keep], vectors[keep]
        self.k, self.dim, self.m = k, vectors.shape[1], m
        self.unit = self.vectors / np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.axes = directions(self.dim, m)
        projected = (self.unit @ self.axes).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        # the place of each vector in each sorted array
        self.places = np.empty((m, len(self.ids)), np.uint16 if len(self.ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(self.ids), dtype=self.places.dtype)[None, :], axis=1)
        self.threshold = max(1, math.floor(m * CHANCE - SLACK * math.sqrt(m * CHANCE * (1 - CHANCE))))

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first places, sizes) of the windows around each query's projections (rows of at), for its radius."""
        width = radius / math.sqrt(self.dim) + 1e-9  # projections of equal vectors may differ in their last digits
        low = np.column_stack([np.searchsorted(row, x - width) for row, x in zip(self.sorted, at.T)])
        high = np.column_stack([np.searchsorted(row, x + width, side="right") for row, x in zip(self.sorted, at.T)])
        return low.astype(self.places.dtype), (high - low).astype(self.places.dtype)

    def collisions(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many of one query's windows each vector stands."""
        inside = self.places - low[:, None] < size[:, None]  # places before a window wrap around
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if self.m < 256 else np.uint16)

    def search(self, own_ids: list[int], vectors: np.ndarray, bounds: list[float | None]) -> list[tuple[list[tuple[float, int]], int]]:
        """For each query (the k nearest as (score, id), ties to the lesser id, how many were verified). A bound is a distance beyond which none is wanted."""
        q = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        at = q @ self.axes
        n = len(own_ids)
        radius = np.array([FIRST_RADIUS if b is None else b for b in bounds])
        own = [self.ids == i for i in own_ids]
        done = [o.copy() for o in own]
        score = [np.full(len(self.ids), -2.0) for _ in range(n)]
        active = list(range(n))
        while active:
            low, size = self.windows(at[active], radius[active])
            further = []
            for row, k in enumerate(active):
                check = np.flatnonzero((self.collisions(low[row], size[row]) >= self.threshold) & ~done[k])
                score[k][check] = self.unit[check] @ q[k]
                done[k][check] = True
                if bounds[k] is not None:
                    continue
                found = np.sort(score[k])[::-1][: self.k]
                enough = len(found) == self.k and found[-1] > -2
                reach = math.sqrt(max(0.0, 2 - 2 * found[-1])) if enough else math.inf
                if reach <= radius[k]:
                    continue
                if radius[k] >= 2 * math.sqrt(self.dim):  # every window holds everything
                    rest = np.flatnonzero(~done[k]) if not enough else np.zeros(0, np.int64)
                    score[k][rest] = self.unit[rest] @ q[k]
                    done[k][rest] = True
                    continue
                radius[k] = min(radius[k] * GROWTH, reach) if enough else radius[k] * GROWTH
                further.append(k)
            active = further
        return [(self._best(vectors[k], score[k]), int((done[k] & ~own[k]).sum())) for k in range(n)]

    def _best(self, vector: np.ndarray, score: np.ndarray) -> list[tuple[float, int]]:
        """The k best of the scored vectors by their exact cosine, each id once."""
        kept = np.flatnonzero(score > -2)
        names, edge = set(), -2.0
        for j in kept[np.argsort(-score[kept], kind="stable")].tolist():
            names.add(int(self.ids[j]))
            edge = score[j]
            if len(names) == self.k:
                break
        best: dict[int, float] = {}
        for j in kept[score[kept] >= edge - 1e-9].tolist():
            best[int(self.ids[j])] = max(best.get(int(self.ids[j]), -2.0), cosine(vector, self.vectors[j]))
        return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[: self.k]


#: Queries that are asked of a shard together.
TOGETHER = 256


FOUND = "query_id long, vec_id long, score double, verified long"


def _asked(rows: DataFrame, k: int) -> DataFrame:
    """FOUND of rows (shard, dim, side, id, vector, bound): the vectors of a shard (side 0), then its queries; a query without a find has one row with a null vec_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, None
        held_ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for batch in batches:
            shard, dim, side = (batch.column(c).to_numpy() for c in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key != (shard[a], dim[a]):
                    key, index = (shard[a], dim[a]), None
                    held_ids, held = [], []
                ids = batch.column(3).slice(a, b - a).to_numpy()
                vectors = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if side[a] == 0:
                    held_ids.append(ids)
                    held.append(vectors)
                    continue
                if index is None and held:
                    index = Index(np.concatenate(held_ids), np.concatenate(held), k)
                    held_ids, held = [], []
                asked, bounds = ids.tolist(), batch.column(5).slice(a, b - a).to_pylist()
                out = []
                for c in range(0, len(asked), TOGETHER):
                    part = slice(c, c + TOGETHER)
                    answers = index.search(asked[part], vectors[part].astype(np.float64), bounds[part]) if index is not None else [([], 0)] * len(asked[part])
                    for i, (found, many) in zip(asked[part], answers):
                        out += [(i, j, s, many if n == 0 else 0) for n, (s, j) in enumerate(found)] or [(i, None, None, many)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "vec_id", "score", "verified"])

    return rows.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "side", "id").mapInArrow(work, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): for each query its k nearest rows of vectors by cosine, its own id left out.

    verified: how many vectors were compared in full for the query, of all
    shards. Vectors that are null, of length zero, or hold a null or non-finite
    number take no part, on either side; a query meets vectors of its own number
    of components. A null id takes no part. A vec_id is one candidate, of its
    vectors the nearest counts; a query id is one query, the least of its
    vectors. Fewer candidates than k give fewer rows; an empty table gives none.

    Vectors are dealt to shards of about `shard` rows, each a bounded index in
    one task. Queries stream past it in batches, so a task holds one shard and
    one batch.
    """
    single = dict(vectors.dtypes)[embedding] == "array<float>" and dict(queries.dtypes)[embedding] == "array<float>"
    kind = "array<float>" if single else "array<double>"
    usable = lambda df: df.selectExpr(f"cast(`{vec_id}` as long) id", f"cast(`{embedding}` as {kind}) vector").filter("id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)").withColumn("dim", F.size("vector"))
    own, bare = usable(vectors), F.lit(None).cast("double")
    shards = max(1, -(-own.count() // shard))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    data = own.select(home.alias("shard"), "dim", F.lit(0).alias("side"), "id", "vector", bare.alias("bound"))
    asked = usable(queries).groupBy("id", "dim").agg(F.min("vector").alias("vector")).groupBy("id").agg(F.min(F.struct("vector", "dim")).alias("q")).select("id", F.col("q.vector").alias("vector"), F.col("q.dim").alias("dim"))
    found = cluster.materialize(_asked(data.unionByName(asked.select(home.alias("shard"), "dim", F.lit(1).alias("side"), "id", "vector", bare.alias("bound"))), k), "neighbours")
    if shards > 1:
        score = F.when(F.count("vec_id") >= k, F.min("score"))  # the k-th found at home
        limits = found.groupBy("query_id").agg(score.alias("kth")).select("query_id", F.when(F.col("kth").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth")))).alias("bound"))
        every = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
        away = asked.join(limits, F.col("id") == F.col("query_id")).select(F.explode(every).alias("shard"), "dim", F.lit(1).alias("side"), "id", "vector", "bound")
        found = found.unionByName(_asked(data.unionByName(away), k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("n"))
    ranked = best.withColumn("verified", F.sum("n").over(Window.partitionBy("query_id"))).filter("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
