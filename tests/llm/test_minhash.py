import random

import pytest

from chronoloom.llm import minhash
from chronoloom.llm.graph import components
from tests.llm.helpers import clashing, docs, words


def brute(texts, width, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(low).encode().split()
        sets.append(set() if not w else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)})
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    label[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def mutated(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width", [4, 5])
def test_groups_equal_comparing_every_pair(spark, width):
    rng = random.Random(width)
    boiler = words(rng, 60)
    texts = [None, "", " \n ", "one", "One", "two words", "TWO words", "Ünï x y z", "ünï x y z"]
    for _ in range(25):
        base = words(rng, rng.choice([6, 20, 80, 200]))
        texts += [mutated(rng, base, k) for k in (0, 0, 1, 2, 3, 5)]
    base = words(rng, 150)
    texts += [mutated(rng, base, 4) for _ in range(60)]  # a large group, some pairs of which are below the threshold
    chain = words(rng, 120)
    for _ in range(12):  # a chain: neighbours are linked, the ends aren't
        texts.append(" ".join(chain))
        chain = chain[6:] + words(rng, 6)
    texts += [" ".join(boiler + words(rng, 90)) for _ in range(40)]  # a passage in common, but not near
    texts += [" ".join(words(rng, 30000)), "x " * 20000]
    rng.shuffle(texts)
    got = minhash.near_duplicates(clashing(docs(spark, texts)), words=width, percent=80)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, width, 80)


def test_copies_rows_without_id_and_empty_tables(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.near_duplicates(docs(spark, [None, "", " "])).where("kept and component_id = doc_id and n_shingles = 0").count() == 3
    text = "a b c d e f g h"
    same = docs(spark, [text] * 50).unionByName(docs(spark, [text] * 2))
    got = minhash.near_duplicates(same).collect()
    assert len(got) == 52 and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 2
    null = spark.createDataFrame([(None, text), (None, text), (4, text), (5, text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(null).collect()), key=repr)
    assert got == [(4, 4, True), (5, 4, False), (None, None, True), (None, None, True)]


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {7} and got[302] == 300 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_values_are_not_posted(spark):
    rng = random.Random(9)
    shared = words(rng, 40)
    df = docs(spark, [" ".join(shared + words(rng, 120, 10**6)) for _ in range(200)])
    classes = minhash.sketches(df).selectExpr("doc_id as node", "sig")
    assert minhash.postings(classes, 35).count() == 0


def test_linked_sets_equals_intersecting_all(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(150, 300), replace=False), rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(40)]
    sets.append(np.empty(0, np.uint64))
    got = minhash.linked_sets(sets[:25], sets[20:], 60, at_once=64)
    for i, x in enumerate(sets[:25]):
        for j, y in enumerate(sets[20:]):
            both = len(np.intersect1d(x, y))
            assert got[i, j] == (100 * both >= 60 * (len(x) + len(y) - both))


def test_communities_of_many_blocks_lose_no_link(spark):
    rng = random.Random(17)
    base = words(rng, 100)
    texts = [mutated(rng, base, rng.randrange(3, 14)) for _ in range(150)]
    df = docs(spark, texts)
    members = spark.createDataFrame([(i, i, 0) for i in range(150)], "node long, component long, community long")
    members = members.join(minhash.sketches(df, 4).selectExpr("doc_id as node", "sig"), "node")
    found = minhash.links_within(members, df.selectExpr("doc_id as node", "text"), 4, 80, least=35, rows=40).collect()
    label = {i: i for i in range(150)}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in found:
        a, b = sorted((find(r["a"]), find(r["b"])))
        label[b] = a
    assert [find(i) for i in range(150)] == [x[2] for x in brute(texts, 4, 80)]


def test_colliding_equals_comparing_all_signatures():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(-(2**31), 2**31, 64).astype(np.int32)
    sigs = np.where(rng.random((200, 64)) < rng.random((200, 1)), base, rng.integers(-3, 3, (200, 64)).astype(np.int32))
    for least in (1, 35, 64):
        x, y = minhash.colliding(sigs[:120], sigs[100:], least, at_once=300)
        want = np.nonzero((sigs[:120, None] == sigs[None, 100:]).sum(axis=2) >= least)
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(zip(*(w.tolist() for w in want), strict=True))
    assert len(minhash.colliding(sigs[:0], sigs, 35)[0]) == len(minhash.colliding(sigs, sigs[:0], 35)[0]) == 0


def test_rows_of_joins_follow_the_group(spark, tmp_path):
    """Twice as many near copies of one text make at most about twice the rows in the postings, leader pairs and stars."""
    from pyspark.sql import functions as F

    counts = []
    for n in (300, 600):
        rng = random.Random(11)
        base = words(rng, 200)
        df = docs(spark, [mutated(rng, base, 8) for _ in range(n)])
        seen = minhash.sketches(df, 4)
        classes = seen.selectExpr("doc_id as node", "sig")
        posted = minhash.postings(classes, 35)
        leader = posted.groupBy("token").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node")).alias(f"m{i}") for i in range(2)])
        led = posted.join(leader, "token").select("node", F.explode(F.array("m0.node", "m1.node")).alias("leader")).distinct()
        counts.append((posted.count(), led.count()))
    assert all(b <= 2.4 * a for a, b in zip(*counts, strict=True)), counts
