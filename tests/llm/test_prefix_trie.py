import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import prefix_trie
from chronoloom.llm.list_ranking import rank_list, sums_before
from tests.llm.helpers import clashing

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def borrowed(c):
    return zlib.crc32(str(c).encode()) % 4


def brute(rows, borrow=borrowed):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [(r.decode(), x.decode()) for *_, r, x in sorted(ts)] for c, ts in turns.items()}
    nodes, ends = {}, {}
    for c, ts in turns.items():
        h = borrow(c)
        whole = tuple(turns.get(c - c % 20, [])[:h] + ts[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    total = {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves, saved = total.get(k, (0, 0))
        leaves += k not in kids
        saved += (len(nodes[k]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0
        total[k] = (leaves, saved)
        if k:
            up = total.get(k[:-1], (0, 0))
            total[k[:-1]] = (up[0] + leaves, up[1] + saved)
    return sorted((min(cs), len(k), min(nodes[k[:-1]]) if k else None, len(cs), len(kids.get(k, ())), *total[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, cs in nodes.items())


def trie(df, **kw):
    kw = kw or {"borrowed": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "lender": F.col("conv_id") - F.col("conv_id") % 20}
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df, **kw).collect())


def talks(rng, n, starts=6):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "word " * rng.randrange(3) + (str(c) if rng.random() < 0.2 else str(rng.randrange(starts)))))
    return rows


def test_equals_building_the_trie(spark):
    rng = random.Random(1)
    rows = talks(rng, 120)
    rows += [(400 + i, t, "user", f"same {t}") for i in range(150) for t in range(5)]  # copies of one conversation
    rows += [(900, t, "user", f"long {t}") for t in range(700)] + [(901, t, "user", f"long {t}") for t in range(350)]
    rows += [(1000 + i, 0, "user", "hello") for i in range(200)] + [(2000, 0, "user", "w " * 50_000)]
    rng.shuffle(rows)
    assert trie(clashing(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_without_borrowing(spark):
    rows = talks(random.Random(2), 60)
    assert trie(spark.createDataFrame(rows, SCHEMA), borrowed=None) == brute(rows, lambda c: 0)


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(0, None, None, None), (0, 1, "user", ""), (0, None, "user", "first"), (1, 0, "", ""), (1, 0, "", ""), (1, 0, "b", "a"), (1, 0, "a", "b"),
            (None, 0, "user", "nobody"), (7, 2, "user", " \n"), (27, 5, "user", "Ünï x"), (27, 5, "user", "Ünï x"), (-3, 1, "user", "below"), (-20, 1, "user", "zero")]
    got = [(*r[:2], *r[3:]) for r in trie(spark.createDataFrame(rows, SCHEMA), borrowed=None)]
    assert got == [(*r[:2], *r[3:]) for r in brute(rows, lambda c: 0)]
    assert trie(spark.createDataFrame([], SCHEMA)) == [] and trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)) == []
    # lent turns only: a conversation with fewer turns than it would borrow, from one that exists or doesn't
    few = [(c, 0, "user", f"t{c}") for c in range(20, 60)]
    assert trie(spark.createDataFrame(few, SCHEMA)) == brute(few)


def test_prefix_hashes_of_cut_conversations_equal_whole_ones(spark):
    turns = [(c, t, "user", f"{c}-{t}", 1) for c in (1, 2) for t in range(3000)] + [(3, 0, "user", "x", 1)]
    df = spark.createDataFrame(turns, SCHEMA + ", words long")
    got = prefix_trie.ranked_turns(df.repartition(6)).withColumn("parts", F.lit(1)).collect()
    values = {r[0]: r[1:] for r in spark.createDataFrame([(f"{c}-{t}",) for c in (1, 2) for t in range(3000)], "text string").select(
        "text", *prefix_trie.turn_values(F.lit("user"), F.col("text"))).collect()}
    for c in (1, 2):
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == list(range(3000))
        for k, (p, b) in enumerate(zip(prefix_trie.PRIMES, prefix_trie.BASES, strict=True)):
            total = 0
            for r in mine:
                assert r[f"x{k}"] == total
                total = (total + values[f"{c}-{r['at']}"][k] * pow(b, r["at"], p)) % p
                assert r[f"a{k}"] == total


def test_primes():
    for p in prefix_trie.PRIMES:
        assert all(p % i for i in range(2, 46341))
    assert prefix_trie.powers(7, np.array([0, 1, 5, 10**6]), 101).tolist() == [pow(7, e, 101) for e in (0, 1, 5, 10**6)]


@pytest.mark.parametrize("few", [10, 10_000])
def test_list_ranking_equals_walking(spark, few):
    rng = random.Random(6)
    ids = rng.sample(range(-10**9, 10**9), 3000)
    df = spark.createDataFrame(list(zip(ids, [*ids[1:], None], strict=True)), "id long, next long")
    assert {r["id"]: r["place"] for r in rank_list(df, few).collect()} == {x: i for i, x in enumerate(ids)}
    assert rank_list(df.limit(0), few).count() == 0
    assert [tuple(r) for r in rank_list(spark.createDataFrame([(5, None)], "id long, next long"), few).collect()] == [(5, 0)]


def test_sums_before_each_place(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(9), rng.randrange(10**12)) for i in range(1000)]
    got = {r["place"]: (r["x"], r["y"]) for r in sums_before(spark.createDataFrame(rows, "place long, x long, y long"), ["x", "y"], 1000).collect()}
    assert got == {i: (sum(r[1] for r in rows[:i]), sum(r[2] for r in rows[:i])) for i in range(1000)}
