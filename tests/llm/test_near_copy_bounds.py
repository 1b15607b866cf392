"""The bounds and the dealing of near copies, against plain sets."""

import itertools
import random

import numpy as np
import pytest

from sessionlake.llm import similar


def test_no_alike_pair_breaks_the_parity_bound():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(1, 3_000))
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        gone = rng.random(len(x)) < rng.random() * 0.3
        y = np.unique(np.concatenate([x[~gone], rng.integers(0, 2**63, int(rng.integers(0, 2 + size // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        jaccard = both / (len(x) + len(y) - both)
        bits = [np.frombuffer(similar.parities(s), np.uint8) for s in (x, y)]
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert differ <= len(x) + len(y) - 2 * both
        assert similar.alike(x, y, 0.8) == (jaccard >= 0.8 - 1e-12)
        if jaccard >= 0.8:
            assert differ <= 0.2 / 1.8 * (len(x) + len(y)) + 1e-9


def texts(groups, copies, seed):
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = [word() for _ in range(120)]
    for _ in range(groups):
        base = shared + [word() for _ in range(80)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small, block, reach", [(64, 20_000, 16), (4, 7, 1), (1, 3, 1)])
def test_groups_equal_all_pairs_however_buckets_are_cut(spark, monkeypatch, small, block, reach):
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar._Rows.nearest, "__defaults__", (reach,))
    rows = texts(25, 9, 3)
    sets = [set(similar.shingle_set(t, 5).tolist()) for t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k) for k in range(len(rows))}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.kept_id for r in similar.groups(docs).collect()} == want and 1 < len(set(want.values())) < len(rows)


def test_shingles_of_equal_words_are_equal():
    assert len(similar.shingle_set("a b c d e f", 5)) == 2 and len(similar.shingle_set("a b", 5)) == 1 and len(similar.shingle_set(" \n", 5)) == 0
    assert set(similar.shingle_set("x a b c d e", 5).tolist()) & set(similar.shingle_set("A  b\tc d E y", 5).tolist())
    assert not set(similar.shingle_set("a b", 5).tolist()) & set(similar.shingle_set("b a", 5).tolist())
