"""Groups of texts whose word-shingle sets are alike: SimHash finds most links, an exact prefix filter the rest, and all are verified.

Texts with one shingle set fall together by a digest of it and are one node.
The fingerprints of the nodes, over their distinct shingles, are compared by
simhash.links. As near copies at the wanted similarity may differ in many bits
of a fingerprint, at which no such comparison is complete, a prefix filter
follows that is: all shingles have one order, those that many texts hold last,
and two sets of at least the wanted similarity share a shingle among the first
of either, as many as the similarity leaves open. So each node goes into the
buckets of those, and no link can be missed. Of buckets with the same nodes one
is enough: that of the earliest shingle.

A pair in a bucket is a candidate if two bounds allow it, which no alike pair
breaks: what is left of both sets from that shingle on can still reach the
similarity, and no more bits differ than elements may. The bits are a set's
hashes folded into BITS parities, so two sets differ in at least as many
elements as their bits do.

Candidates are verified by their whole sets: first those of SimHash and, for
each node of a bucket, the one with the fewest differing bits among its
neighbours in a few orders; then all whose two nodes the links found so far
leave in different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import cluster
from sessionlake.llm import columns, simhash
from sessionlake.operators import graphs

#: Bits that fingerprints of first candidates differ in at most.
RADIUS = 3
#: Which shingles are common is told by a sample of about so many different texts. It and the number of common ones bear on the order
#: of shingles alone, and any order gives the same groups.
SAMPLE, COMMON, COMMON_LEAST = 30_000, 500_000, 3
#: Places further on in an order of a bucket up to which a node looks for the nearest other at first.
REACH = 16
#: Parities of a set's hashes.
BITS = 1024
#: Buckets of at most so many nodes are compared together, lag by lag; those of more than BLOCK are cut into blocks, and each two of them go to a task.
SMALL, BLOCK = 64, 20_000
#: Digests that a task remembers as dealt; beyond them it forgets, and a text may be dealt again.
REMEMBERED = 500_000
#: Pairs that are held before they are sent on.
HELD_PAIRS = 2_000_000

_GOLDEN = 0x9E3779B97F4A7C15
_WHOLE = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits spread so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(words: int) -> list[np.uint64]:
    """An odd number for each place of a shingle."""
    return [np.uint64(int(f) | 1) for f in _mixed(np.array([(k + 1) * _GOLDEN & _WHOLE for k in range(words)], np.uint64))]


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending. A shingle's hash is made of its words' XXH64 and their places; fewer words than a shingle has make one."""
    own = [np.fromiter(map(xxhash.xxh64_intdigest, run), np.uint64, len(run)) for run in simhash._word_runs(text.encode("utf-8", "replace").lower())]
    word = np.concatenate(own) if own else np.zeros(0, np.uint64)
    if not len(word):
        return word
    size = min(words, len(word))
    total = np.full(len(word) - size + 1, size * _GOLDEN & _WHOLE, np.uint64)
    for k, factor in enumerate(_factors(size)):
        total += word[k : len(word) - size + 1 + k] * factor
    return np.unique(_mixed(total))


def _node(text: str, own: np.ndarray) -> int:
    """The name of a shingle set, or of a text without words: 64 bits of a digest."""
    data = b"s" + own.tobytes() if len(own) else b"t" + text.encode("utf-8", "replace")
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)


def prefix(own: np.ndarray, common: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, one of which every set that is alike has among its own first ones.

    common: shingles that come last, ascending; place: their places among themselves.
    """
    size = len(own)
    if not size:
        return own
    most = size - int(np.ceil(similarity * size - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, place[at] + 1, 0), kind="stable")]
    return own[:most]


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have at least a Jaccard similarity; empty ones are like none."""
    if not len(x) or not len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-12


def parities(own: np.ndarray) -> bytes:
    """How often a set's hashes fall on each of BITS places, odd or even."""
    return np.packbits(np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


class _Rows:
    """Rows of whole buckets, as arrays."""

    def __init__(self, table: pa.Table, similarity: float):
        table = table.combine_chunks()
        self.bucket, self.node, self.label, self.size, self.rest, self.side, self.fp = (table.column(c).to_numpy() for c in ("bucket", "node", "label", "size", "rest", "side", "fp"))
        bits = table.column("bits").combine_chunks()
        bits = bits if isinstance(bits, pa.Array) else bits.chunk(0)
        self.bits = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(self.node), BITS // 64)
        self.share, self.odd = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs (a[k], b[k]) of different labels that both bounds allow."""
        apart = (self.label[a] != self.label[b]) & ((self.side[a] == 0) | (self.side[a] != self.side[b]))
        total = self.size[a].astype(np.int64) + self.size[b]
        kept = np.flatnonzero(apart & (np.minimum(self.rest[a], self.rest[b]) >= self.share * total - 1e-9))
        return kept[self.differ(a[kept], b[kept]) <= self.odd * total[kept] + 1e-9]

    def nearest(self, reach: int = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row the one of its bucket with the fewest differing bits among those up to `reach` places away, in the orders of names, fingerprints and sizes."""
        for by in (self.node.view(np.uint64) * np.uint64(_GOLDEN), self.fp, self.size):
            order = np.lexsort((by, self.bucket))
            least, partner = np.full(len(order), BITS + 1), np.full(len(order), -1)
            for lag in range(1, reach + 1):
                met = np.flatnonzero(self.bucket[order[:-lag]] == self.bucket[order[lag:]])
                if not len(met):
                    break
                a, b = order[met], order[met + lag]
                kept = self.may(a, b)
                a, b = a[kept], b[kept]
                far = self.differ(a, b)
                for one, other in ((a, b), (b, a)):  # a row stands once on either side of a lag
                    nearer = far < least[one]
                    least[one[nearer]], partner[one[nearer]] = far[nearer], other[nearer]
            found = np.flatnonzero(partner >= 0)
            yield found, partner[found]

    def crossing(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of a bucket that may be alike and have different labels."""
        starts = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1]))
        sizes = np.diff(np.append(starts, len(self.bucket)))
        rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        own = self.bucket[rows]
        for lag in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            met = np.flatnonzero(own[:-lag] == own[lag:])
            a, b = rows[met], rows[met + lag]
            kept = self.may(a, b)
            yield a[kept], b[kept]
        for c in np.flatnonzero(sizes > SMALL).tolist():
            rows = np.arange(starts[c], starts[c] + sizes[c])
            _, of = np.unique(self.label[rows], return_inverse=True)
            # the largest component last: its own rows are met by all others and need no turn
            many = np.bincount(of)
            rows = rows[np.argsort(of == np.argmax(many), kind="stable")]
            for k in range(len(rows) - int(many.max())):
                a, b = np.full(len(rows) - k - 1, rows[k]), rows[k + 1 :]
                kept = self.may(a, b)
                yield a[kept], b[kept]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows again, cut between buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        first = int(np.argmax(key == key[-1]))
        if held and (first or held[-1].column(0)[-1].as_py() != int(key[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        elif first:
            yield pa.Table.from_batches([batch.slice(0, first)])
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


DRAWN = "key binary, doc_id long, node long, fp long, bits binary"
DEALT = "bucket long, node long, size int, rest int"
MET = "s1 long, s2 long, left long, bucket long, node long, size int, rest int"


def _dealt(rows: DataFrame, drawn: DataFrame, words: int, similarity: float) -> DataFrame:
    """DEALT: the buckets of two nodes or more, of those with the same nodes one. A sample of different texts, by their hashes, tells which shingles are common."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in columns.slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([shingle_set(t, words) for t in texts]).view(np.int64))})

    share = max(1, drawn.select("node").distinct().count() // SAMPLE)
    drawn_texts = rows.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()
    counted = drawn_texts.mapInArrow(sample, "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON_LEAST)
    held = counted.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    common = held.column("shingle").to_numpy().view(np.uint64)
    place = np.arange(len(common), 0, -1)
    common, place = np.sort(common), place[np.argsort(common)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, texts in columns.slices(batch, "text"):
                node, size, first = [], [], []
                for t in texts:
                    shingles = shingle_set(t, words)
                    if not len(shingles) or (name := _node(t, shingles)) in sent:
                        continue
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(name)
                    node.append(name), size.append(len(shingles)), first.append(prefix(shingles, common, place, similarity))
                if not node:
                    continue
                many = np.array([len(f) for f in first])
                sizes = np.repeat(np.array(size, np.int32), many)
                places = np.concatenate([np.arange(m, dtype=np.int32) for m in many.tolist()])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.concatenate(first).view(np.int64)), "node": pa.array(np.repeat(np.array(node, np.int64), many)), "size": pa.array(sizes), "rest": pa.array(sizes - places)})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets of two nodes or more, each node once, with sums over the names of a bucket's nodes and what is left of them."""
        for table in _whole_buckets(batches):
            key, node, size, rest = (table.column(c).to_numpy() for c in ("bucket", "node", "size", "rest"))
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key = key[fresh]
            alone = np.append(True, key[1:] != key[:-1]) & np.append(key[1:] != key[:-1], True)
            chosen = np.flatnonzero(fresh)[~alone]
            if not len(chosen):
                continue
            key, node, size, rest = key[~alone], node[chosen], size[chosen], rest[chosen]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many = np.diff(np.append(starts, len(key)))
            one = _mixed(node.view(np.uint64))
            sums = [np.repeat(np.add.reduceat(x, starts), many) for x in (one, _mixed(one + np.uint64(_GOLDEN)), rest.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(-sums[2]), pa.array(key), pa.array(node), pa.array(size), pa.array(rest)], names=[c.split()[0] for c in MET.split(", ")])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first bucket of each set of nodes; rows come sorted by the set, what is left, and the bucket."""
        last: tuple[int, int] | None = None
        kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, key = (batch.column(c).to_numpy() for c in (0, 1, 3))
            new = np.append(last is None or last != (int(one[0]), int(two[0])), (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
            first = key[np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))]
            begun = np.cumsum(new) > 0
            first = np.where(begun, first, kept)
            own = key == first
            last, kept = (int(one[-1]), int(two[-1])), int(first[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(own)), *(batch.column(c).filter(pa.array(own)) for c in (4, 5, 6))], names=["bucket", "node", "size", "rest"])

    dealt = rows.mapInArrow(deal, DEALT).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(shared, MET)
    return dealt.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "left", "bucket").mapInArrow(once, DEALT)


def _labelled(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, doc_id, label) of every row of (key, doc_id, text): rows of one label are one group."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in columns.slices(batch, "text"):
                sets = [shingle_set(t, words) for t in texts]
                fps = simhash.fingerprints_of(enumerate(sets), len(sets)).view(np.int64)
                bare = np.array([not len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array([_node(t, s) for t, s in zip(texts, sets)], pa.int64()), pa.array(fps, pa.int64(), mask=bare), pa.array([parities(s) if len(s) else None for s in sets], pa.binary())], names=["key", "doc_id", "node", "fp", "bits"])

    drawn = cluster.materialize(rows.mapInArrow(draw, DRAWN), "nodes")
    buckets = cluster.materialize(_dealt(rows, drawn, words, similarity), "buckets")
    in_buckets = buckets.select("node").distinct()
    sketches = cluster.materialize(drawn.filter("fp is not null").join(in_buckets, "node", "left_semi").groupBy("node").agg(F.min("fp").alias("fp"), F.min("bits").alias("bits")), "sketches")

    # written, so that Spark knows that they are few and moves no bucket to find them
    large = cluster.materialize(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-buckets")

    def met(labels: DataFrame | None) -> DataFrame:
        """(a, b): pairs of nodes that may be alike. Without labels those nearest to each other, else all of different labels."""

        at_first = labels is None

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_buckets(batches):
                own = _Rows(table, similarity)
                left, right, many = [], [], 0

                def pairs() -> pa.RecordBatch:
                    a, b = own.node[np.concatenate(left)], own.node[np.concatenate(right)]  # noqa: B023
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    left.clear(), right.clear()  # noqa: B023
                    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

                for a, b in own.nearest() if at_first else own.crossing():
                    if not len(a):
                        continue
                    left.append(a), right.append(b)
                    many += len(a)
                    if many >= HELD_PAIRS:
                        yield pairs()
                        many = 0
                if left:
                    yield pairs()

        sketched = buckets.join(sketches, "node")
        marked = sketched.withColumn("label", F.col("node")) if labels is None else sketched.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
        split = marked.join(large, "bucket", "left").withColumn("block", block)
        if labels is None:  # neighbours of one block are enough at first
            placed = split.select(F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "block")).alias("bucket"), "node", "label", "size", "rest", F.lit(0).alias("side"), "fp", "bits")
        else:
            other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
            spread = split.withColumn("other", other)
            low, high = F.least("block", "other"), F.greatest("block", "other")
            side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") == low, 1).otherwise(2)
            # the rows of a block meet each other where other is the block itself
            placed = spread.select(F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", low, high)).alias("bucket"), "node", "label", "size", "rest", side.alias("side"), "fp", "bits")
        return placed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(compare, "a long, b long").distinct()

    def by_fingerprint() -> DataFrame:
        """(a, b): pairs of nodes whose fingerprints are equal or near, each fingerprint's least node standing for it. Only nodes of buckets can be alike to others."""
        least = sketches.groupBy("fp").agg(F.min("node").alias("least"))
        same = sketches.select("node", "fp").join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
        near = simhash.links(least, RADIUS)
        of = lambda c, to: least.select(F.col("fp").alias(c), F.col("least").alias(to))
        far = near.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return same.union(far)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of texts, each once in a task, however often a document repeats."""
        sent: set[int] = set()
        for batch in batches:
            for _, texts in columns.slices(batch, "text"):
                named = {_node(t, s): s for t, s in ((t, shingle_set(t, words)) for t in texts)}
                fresh = [n for n in named if n not in sent]
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.update(fresh)
                yield pa.RecordBatch.from_pydict({"node": pa.array(fresh, pa.int64()), "own": pa.array([named[n].tobytes() for n in fresh], pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sound(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # a row of 16 bytes for each text to verify; while they are few, texts are filtered where they are
        bearers = cluster.materialize(drawn.select("node", "key").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key"), "bearers")
        sets = cluster.materialize(rows.join(cluster.few(bearers), "key", "left_semi").select("text").mapInArrow(shingles, "node long, own binary"), "shingle-sets")
        left, right = sets.select(F.col("node").alias("a"), F.col("own").alias("x")), sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
        found = cluster.materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
        cluster.discard(sets)
        cluster.discard(bearers)
        return found

    first = cluster.materialize(by_fingerprint().union(met(None)).distinct(), "candidates")
    links = sound(first)
    labels = graphs.components(links)
    crossing = cluster.materialize(met(labels).join(first, ["a", "b"], "left_anti"), "candidates")
    if crossing.limit(1).count():
        more = sound(crossing)
        labels = graphs.components(links.union(more))
        cluster.discard(more)
    for past in (first, crossing, links, buckets, sketches, large):
        cluster.discard(past)
    return drawn.select("key", "doc_id", "node").join(labels, "node", "left").select("key", "doc_id", F.coalesce("label", "node").alias("label"))


def _key(doc_id: Column, text: Column) -> Column:
    """What tells a document: its id, or that it has none, and its text; 16 bytes."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))
    return F.substring(F.unhex(F.sha2(whole, 256)), F.lit(1), F.lit(16))


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_id) of every row with an id: kept_id is the least doc_id of the group.

    Groups are the components of links between texts whose sets of `words`-word
    shingles (A-Z lower-cased, words between white space) have a Jaccard
    similarity of at least `similarity`; copies are in one group. Texts without
    words are alike only as copies; null is empty. Rows with a null id are left
    out. Other columns are not read; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    named = _labelled(own.select(_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text"), words, similarity)
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("kept_id")), "label").select("doc_id", "kept_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all columns, others unread: that of least doc_id, a null id last, of equals the one of least digest.

    A document is an id and a text, so rows of one id with different texts are
    judged apart, and an id may stay with several texts that are not alike. Rows
    that repeat in both are one document; of these the least in all columns
    stays. A null text is empty, and all empty texts are one group. An empty
    table stays empty.
    """
    names = docs.columns
    own = "_key"
    while own in names:
        own += "_"
    keyed = docs.withColumn(own, _key(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    rows = keyed.select(F.col(own).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    named = _labelled(rows, words, similarity)
    by_key = named.groupBy("key", "label").agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key"))
    kept = by_key.groupBy("label").agg(first.alias("least")).select("label", F.col("least.key").alias("kept"))
    # a row of 16 bytes for each document that goes; while they are few, texts stay where they are
    judged = cluster.materialize(by_key.join(kept, "label").select(F.col("key").alias(own), (F.col("key") == F.col("kept")).alias("stays"), "rows").filter("not stays or rows > 1"), "judged")
    single = keyed.join(cluster.few(judged.select(own)), own, "left_anti").select(*names)
    repeated = keyed.join(cluster.few(judged.filter("stays").select(own)), own, "left_semi")
    once = repeated.groupBy(own).agg(F.min(F.struct(*names)).alias("r")).select("r.*")
    return single.unionByName(once)
