import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import hard_negatives
from chronoloom.llm.vectors import whole_products
from tests.llm.helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """From (id, vector, label) with whole arithmetic in Python's integers."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
             if i is not None and lab is not None and v and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    whole = [min((r for r in whole if r[0] == i), key=lambda r: (r[2], r[1])) for i in sorted({r[0] for r in whole})]
    edge, out = 2**63 - 1, []
    for a, q, lab in whole:
        if a % every == 0:
            scored = [(max(-edge, min(edge, sum(x * y for x, y in zip(q, v, strict=True)))), i, other == lab) for i, v, other in whole if i != a and len(v) == len(q)]
            scored.sort(key=lambda s: (-s[0], s[1]))
            for ps, p, _ in [s for s in scored if s[2]][:positives]:
                fits = [s for s in scored if not s[2] and low * ps <= 100 * s[0] <= high * ps][:negatives]
                out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.mine(df, **kw).collect())


@pytest.mark.parametrize("blocks", [(4096, 8192), (64, 3)])
def test_equals_scoring_everything(spark, blocks):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 12)).astype(np.float32)
    x[100:200] = x[50]  # many equal scores
    x[0] = 0
    rows = [(i, x[i].tolist(), int(rng.integers(0, 4)) if i < 600 else 1) for i in range(800)]
    got = mined(clashing(spark.createDataFrame(rows, SCHEMA)), every=25, rows_per_block=blocks[0], anchors_per_block=blocks[1])
    assert got == brute(rows, 25) and len(got) > 100


def test_label_expression_and_other_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    changed = [(i, v, (lab + 1) % 3 if i % 7 == 0 else lab) for i, v, lab in rows]
    assert mined(df, label=label, every=20, positives=2, negatives=6, low=20, high=99) == brute(changed, 20, 2, 6, 20, 99)


def test_rows_that_take_no_part_and_mixed_dimensions(spark):
    bad = [(None, [1.0, 1.0], 0), (0, None, 0), (1, [], 0), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 0), (5, [1.0, 1.0], None)]
    good = [(50, [2.0, 1.0], 0), (50, [2.0, 1.0], 0), (51, [2.0, 1.1], 0), (52, [1.5, 0.9], 1), (53, [1.4, 1.0], 1), (53, [9.0, 9.0], 2), (54, [1.0, 1.0, 1.0], 1), (100, [1.0, 2.0, 1.0], 1)]
    got = mined(spark.createDataFrame(bad + good, SCHEMA))
    assert got == brute(bad + good) and {r[0] for r in got} == {50}
    assert mined(spark.createDataFrame([], SCHEMA)) == mined(spark.createDataFrame(bad, SCHEMA)) == mined(spark.createDataFrame(good[:1], SCHEMA)) == []


def test_large_components_and_equal_scores_at_zero(spark):
    rows = [(0, [6e4, 6e4], 0), (1, [6e4, 5e4], 0), (2, [5e4, 5e4], 1), (3, [1e30, 1.0], 0), (4, [8e29, 0.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, -1.0], 0), (50, [0.0, 0.0], 0)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and any(r[0] == 50 and r[4] == 0 for r in got)


def test_whole_products_are_exact_at_every_size():
    rng = np.random.default_rng(3)
    left = np.floor(rng.normal(size=(30, 9)) * 10.0 ** rng.integers(0, 14, (30, 1)))
    right = np.floor(rng.normal(size=(40, 9)) * 10.0 ** rng.integers(0, 14, (40, 1)))
    edge = 2**63 - 1
    want = [[max(-edge, min(edge, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in right] for x in left]
    assert whole_products(left, right).tolist() == want


def test_keys_sort_like_their_values():
    rng = np.random.default_rng(4)
    anchor, score, ids = (rng.integers(-5, 5, 500) * 10**16 for _ in range(3))
    keys = hard_negatives.pack(anchor, score, 1, ids)
    want = sorted(zip(anchor.tolist(), (-score).tolist(), ids.tolist(), strict=True))
    assert [(a, -s, i) for a, s, _, i in map(hard_negatives.unpack, sorted(keys))] == want


def test_stream_holds_open_windows_only():
    """A long run of negatives passes with at most the windows of one anchor in memory."""
    keys = iter(hard_negatives.pack(np.array([1]), np.array([1000]), 0, np.array([7])) + hard_negatives.pack(
        np.full(2000, 1), np.arange(2000, 0, -1), 1, np.arange(2000)))
    ordered = sorted(keys)
    assert list(hard_negatives.stream(iter(ordered), 3, 50, 95)) == [(1, 7, 1, 1050, 1000, 950), (1, 7, 2, 1051, 1000, 949), (1, 7, 3, 1052, 1000, 948)]
