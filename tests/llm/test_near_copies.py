"""Groups of near copies against all pairs, for the shapes of difference that sampling of sketches misses."""

import itertools
import random

from sessionlake.llm import similar


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


def check(spark, texts):
    sets = [set(similar.shingle_set(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
            label[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k) for k in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.kept_id for r in similar.groups(docs).collect()} == want
    return want


def test_a_bridge_with_many_nearer_copies(spark):
    base = words(1, 200)
    near = [base[:-1] + [w] for w in words(2, 8)]
    bridge = base[:-10] + words(3, 10)
    far = words(4, 16) + bridge[16:]
    want = check(spark, [" ".join(t) for t in [far, *near, bridge]])
    assert set(want.values()) == {0}


def test_copies_among_many_texts_of_one_template(spark):
    shared, texts = words(5, 170), []
    for k in range(300):
        own = shared + words(100 + k, 22)
        texts += [" ".join(own), " ".join(own[:-3] + words(1000 + k, 3))]
    random.Random(6).shuffle(texts)
    assert len(set(check(spark, texts).values())) == 300


def test_a_line_repeated_many_times(spark):
    texts = []
    for k in range(10):
        own, line = words(2000 + k, 500), words(3000 + k, 10)
        texts += [" ".join(own), " ".join(own + line * 20)]
    assert len(set(check(spark, texts).values())) == 10


def test_appended_and_replaced_blocks_at_the_threshold(spark):
    texts = []
    for k in range(150):
        own = words(4000 + k, 200)
        texts += [" ".join(own), " ".join(own + words(5000 + k, 48))]
        own = words(6000 + k, 200)
        texts += [" ".join(own), " ".join(own[:80] + words(7000 + k, 17) + own[97:])]
    assert len(set(check(spark, texts).values())) == 300
