import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import sharding
from tests.llm.helpers import clashing, docs


def test_matrix_has_exact_sums_and_the_hypergeometric_mean():
    blocks = [100, 0, 37, 64]
    draws = np.array([sharding.communication_matrix(blocks, 8, s) for s in range(400)])
    assert (draws.sum(axis=2) == blocks).all()
    sizes = draws.sum(axis=1)
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and (sizes.sum(axis=1) == 201).all()
    mean = draws.mean(axis=0)
    assert np.allclose(mean[0], 100 * sizes[0] / 201, atol=0.6)
    n, good = 100, sizes[0][0]
    var = n * good / 201 * (1 - good / 201) * (201 - n) / 200
    assert abs(draws[:, 0, 0].var() / var - 1) < 0.35


def test_large_counts_stay_exact():
    m = sharding.communication_matrix([3 * 10**9, 10**9], 2, 1)
    assert m.sum(axis=0).tolist() == [2 * 10**9, 2 * 10**9] and m.sum(axis=1).tolist() == [3 * 10**9, 10**9] and (m >= 0).all()


def test_draws_of_large_counts_have_the_hypergeometric_moments():
    rng = np.random.Generator(np.random.PCG64(5))
    good, bad = 4 * 10**10, 6 * 10**10
    for draws in (10**10, 9 * 10**10):
        x = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(3000)], float)
        share, total = good / (good + bad), good + bad
        mean, var = draws * share, draws * share * (1 - share) * (total - draws) / (total - 1)
        assert abs(x.mean() - mean) < 4 * (var / len(x)) ** 0.5 and abs(x.var() / var - 1) < 0.12


def test_thinning_has_the_law_of_drawing_one_by_one(monkeypatch):
    monkeypatch.setattr(sharding, "ONE_BY_ONE", 2)
    rng = np.random.Generator(np.random.PCG64(6))
    good, bad, draws, n = 9, 14, 8, 20_000
    seen = np.bincount([sharding._hypergeometric(rng, good, bad, draws, most=1) for _ in range(n)], minlength=draws + 1)
    law = np.array([math.comb(good, i) * math.comb(bad, draws - i) for i in range(draws + 1)]) / math.comb(good + bad, draws)
    assert ((seen - n * law) ** 2 / np.maximum(n * law, 1)).sum() < 30  # 8 degrees of freedom: exceeded once in 5000


@pytest.mark.parametrize("n", [0, 1, 7, 8, 403])
def test_shards_are_even_slots_gapless_and_runs_agree(spark, n):
    df = clashing(docs(spark, [None if i % 50 == 3 else "same" for i in range(n)]))
    placed = sharding.shuffle_shards(df, by=["doc_id"], shards=8, blocks=11)
    rows = [(r["doc_id"], r["shard"], r["slot"]) for r in placed.collect()]
    assert sorted(r[0] for r in rows) == list(range(n))
    sizes = [sum(r[1] == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r[2] for r in rows if r[1] == s) == list(range(sizes[s]))
    again = sharding.shuffle_shards(df, by=["doc_id"], shards=8, blocks=11)
    assert sorted(rows) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again.repartition(3).collect())
    if n == 403:
        assert abs(np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1]) < 0.2
        assert abs(np.corrcoef([r[0] for r in rows], [r[2] for r in rows])[0, 1]) < 0.2


def test_null_keys_repeated_rows_and_written_shards(spark, tmp_path):
    df = docs(spark, ["a"] * 5).unionByName(docs(spark, ["a"] * 5)).withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id")))
    placed = sharding.shuffle_shards(df, by=["doc_id", "text"], shards=3)
    assert placed.count() == 10 and placed.select("shard", "slot").distinct().count() == 10
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [3, 3, 4]
    for shard in range(3):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [s for f in files for s in pq.read_table(f)["slot"].to_pylist()]
        assert slots == list(range(len(slots)))
