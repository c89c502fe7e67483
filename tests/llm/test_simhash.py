import random

import numpy as np
import pytest
import xxhash

from chronoloom.llm import queries, simhash
from tests.llm.helpers import clashing, docs, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, width=3):
    w = (text or "").translate(LOW).encode().split()
    if not w:
        return 0
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, prints, most=2):
    label = dict(zip(ids, ids, strict=True))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    bits = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= most)[0]:
            a, b = sorted((find(ids[i]), find(ids[j])))
            label[b] = a
    return [find(i) for i in ids]


def expect(texts):
    prints = [brute_print(t) for t in texts]
    return [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_groups(list(range(len(texts))), prints), strict=True))]


def test_golay_code_is_perfect_and_near_words_share_a_key():
    low, high, errors = simhash.golay_tables()
    weights = np.bitwise_count(errors)
    assert sorted(np.unique(errors[:, 0]).tolist()) == sorted({e for e in range(1 << 23) if e.bit_count() <= 3})
    assert ((weights[:, 0] < 3) | ((weights[:, 1:] == 4).all(axis=1))).all()
    assert all(len(set(row)) == 6 for row in errors[weights[:, 0] == 3].tolist())
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 20_000)
    for flips in range(3):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, 23, len(x))
        one, two = simhash.golay_keys(x), simhash.golay_keys(y)
        assert (one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).all()


def test_prints_within_two_bits_share_a_posting():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64))
    keys = [set() for _ in range(10_000)]
    for r, k in zip(*simhash.segment_keys(np.concatenate([x, y])), strict=True):
        keys[r].add(int(k))
    assert all(keys[i] & keys[i + 5000] for i in range(5000)) and max(map(len, keys)) <= 18


def test_groups_equal_comparing_every_pair(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "ONE", "two words", "Two  WORDS", "Ünï x y z", "ünï X y z", "Ünï x y z"]
    for _ in range(30):
        base = words(rng, rng.choice([4, 30, 400]))
        for edits in (0, 1, 2, 4):
            out = list(base)
            for _ in range(edits):
                out[rng.randrange(len(out))] = f"m{rng.randrange(99)}"
            texts.append(" ".join(out))
    texts += [" ".join(words(rng, 150_000)), "x " * 70_000, "y" * 300_000]
    rng.shuffle(texts)
    got = simhash.near_duplicates(clashing(docs(spark, texts)))
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == expect(texts)
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) and r["print"] % 2**64 == int(r["fingerprint"], 16) for r in got.collect())


@pytest.mark.parametrize(("bits", "crowd"), [(2, 64), (2, 3), (1, 64), (1, 3)])
def test_crowded_lists_lose_no_link(spark, bits, crowd):
    rng = random.Random(4)
    center, prints = rng.getrandbits(64), set()
    while len(prints) < 500:  # a ball, a long chain and strangers
        prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    step = center ^ (1 << 63)
    for b in rng.sample(range(64), 40):
        step ^= 1 << b
        prints.add(step)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(100)})
    rows = [(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "node long, print long"), bits, crowd, rows_per_task=500).collect()
    assert all((prints[r["a"]] ^ prints[r["b"]]).bit_count() <= 64 for r in links)
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in links:
        a, b = sorted((find(r["a"]), find(r["b"])))
        label[b] = a
    assert [find(i) for i in range(len(prints))] == brute_groups(list(range(len(prints))), prints, bits)


def test_work_of_a_crowd_has_a_bound_per_fingerprint(spark):
    """No pair of a large group becomes a row: 18 postings and 64 links at most for each fingerprint."""
    for n in (400, 1600):
        rng, prints = random.Random(5), set()
        while len(prints) < n:
            prints.add(sum(1 << b for b in rng.sample(range(20), rng.randrange(6))))
        df = spark.createDataFrame([(i, p) for i, p in enumerate(sorted(prints))], "node long, print long")
        assert simhash.postings(df).count() <= 18 * n and simhash.link_fingerprints(df).count() <= 64 * n


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (7, "a b c"), (9, None), (8, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == [(4, 4, True), (4, 4, True), (7, 4, False), (8, 8, True), (9, 8, False), (None, None, True), (None, None, True)]


def test_query_equals_brute_force_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), brute_groups(ids, prints), strict=True))
    assert sorted(map(tuple, queries.QUERIES["op11_simhash_golay"](spark, sf).collect())) == want
