import numpy as np
import pytest

from chronoloom.llm import multi_index, topk
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, ids, every, k, score):
    out = []
    for a, q in zip(ids, vectors, strict=True):
        if a % every == 0:
            scored = sorted((-score(q, v), b) for b, v in zip(ids, vectors, strict=True) if b != a)[:k]
            out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(scored)]
    return out


def whole(q, v):
    return int((np.floor(256 * q.astype(np.float64)) * np.floor(256 * v.astype(np.float64))).sum())


@pytest.mark.parametrize("scale", [0.1, 3.0])
def test_top_k_equals_scoring_everything(spark, scale):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(700, 20)) * scale).astype(np.float32)
    x[100:160] = x[7]  # ties
    x[5] = 0
    got = topk.exact_top_k(clashing(table(spark, x)), k=5, every=50, rows_per_block=128, queries_per_block=4)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(x, range(700), 50, 5, whole)


def test_bounds_cut_work_but_no_result():
    rng = np.random.default_rng(2)
    columns = np.floor(256 * rng.normal(size=(32, 500)))
    q = np.floor(256 * rng.normal(size=32))
    ids = np.arange(500)
    all_scores = q @ columns
    best = np.lexsort((ids, -all_scores))[:5]
    for floor in (-np.inf, all_scores[best[-1]], all_scores[best[2]]):
        found, scores = topk.branch_and_bound(q, -1, columns, (columns**2).sum(axis=0), ids, 5, floor)
        want = [i for i in best if all_scores[i] >= floor]
        assert found.tolist() == want and scores.tolist() == all_scores[want].tolist()


def test_components_of_any_size_are_scored_in_whole_numbers(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[0] = 60_000.0  # meets itself and ordinary vectors
    x[50] = 3e7 * rng.normal(size=16)  # products beyond 2^53
    x[51], x[52], x[53] = x[50], x[50] + 1 / 256, -x[50]
    x[100], x[101], x[102] = 1e300, 1e300, -1e300  # beyond a long
    x[7] = 1.7e308
    edge = 2**63 - 1

    def score(q, v):
        big = [np.clip(np.floor(np.clip(256 * w, -topk.LARGEST, topk.LARGEST)), -topk.LARGEST, topk.LARGEST) for w in (q, v)]
        return max(-edge, min(edge, sum(int(a) * int(b) for a, b in zip(*big, strict=True))))

    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], schema)
    got = topk.exact_top_k(df, k=5, every=50, rows_per_block=64, queries_per_block=4)
    with np.errstate(over="ignore"):
        want = brute(x, range(300), 50, 5, score)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


BAD = [None, [], [1.0, None, 0.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]


@pytest.mark.parametrize("search", [lambda d: topk.exact_top_k(d, k=3, every=2), lambda d: multi_index.nearest(d, k=3, every=2)])
def test_rows_that_take_no_part(spark, search):
    good = [[1, 0, 0], [0, 1, 0], [1, 1, 0], [0.5, 0, 0.5]]
    df = table(spark, BAD + good, ids=range(10))
    got = search(df).collect()
    assert {r["query_id"] for r in got} == {6, 8} and {r["vec_id"] for r in got} == {6, 7, 8, 9} and len(got) == 6
    assert search(df.limit(0)).count() == 0
    assert search(table(spark, [[1.0, 2.0]])).count() == 0
    null = spark.createDataFrame([(None, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in search(null).collect()) == [(2, 1, 3)]


def test_index_recall_order_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1400] = x[10]  # one cell of many entries, all tied
    got = multi_index.nearest(clashing(table(spark, x)), k=20, every=20, rows_per_block=256, queries_per_block=32).collect()
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    hits = 0
    assert len(per) == 150
    for q, found in per.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        scores = (wide * wide[q]).sum(axis=1)
        assert np.allclose([f[2] for f in found], scores[[f[1] for f in found]], atol=1e-12)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        scores[q] = -np.inf
        kth = np.sort(scores)[-20]
        hits += sum(f[2] >= kth - 1e-12 for f in found)
    assert hits / (20 * len(per)) >= 0.9
    tied = [f[1] for f in sorted(per[1000])]
    assert tied == sorted([10, *range(1001, 1400)])[:20]


def test_few_rows_are_all_found(spark):
    x = np.random.default_rng(4).normal(size=(60, 7)).astype(np.float32)
    got = multi_index.nearest(table(spark, x), k=20, every=20)
    want = brute(x, range(60), 20, 20, lambda q, v: float((q.astype(float) * v.astype(float)).sum()))
    assert [r[:3] for r in sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect()))] == [w[:3] for w in want]


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(5)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    cells = multi_index.walk(a, b, counts, 10**9)
    want = sorted((a[i] + b[j], i * 7 + j) for i in range(9) for j in range(7) if counts[i, j])
    assert cells == [c for _, c in want]
    some = multi_index.walk(a, b, counts, 12)
    assert some == cells[: len(some)] and counts.ravel()[some].sum() >= 12 > counts.ravel()[some[:-1]].sum()
