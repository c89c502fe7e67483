from collections import Counter
import random

import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import mixing
from tests.llm.helpers import clashing, docs


def brute_targets(sizes, weights, most):
    """Share by weight; fix what is above its bound and share the rest again, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, rest = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free} if free else {}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**fixed, **share}
        for s in above:
            fixed[s] = most * sizes[s]
            rest -= fixed[s]


def corpus(spark, seed=0, sources=("a", "b", "Z", "é", None, "c", "d")):
    rng = random.Random(seed)
    texts = []
    for i, s in enumerate(sources):
        for _ in range(30 + 40 * (i == 1)):
            texts.append((" ".join(["x"] * rng.choice([0, 1, 3, 10, 40, 40, 200])) if rng.random() > 0.05 else None, s))
    return docs(spark, texts)


def test_targets_equal_sharing_by_hand(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sizes = {s: rng.choice([0, 5, 50, 3000]) for s in ["a", "b", "c", "B", "ü", None, "e"]}
        df = spark.createDataFrame([(s, n, 3) for s, n in sizes.items()], "source string, source_size long, docs long")
        want = brute_targets(sizes, (5, 2, 1), 3.0)
        for r in mixing.targets(df).collect():
            assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]]), (seed, r)


def test_rates_solve_the_dual_and_copies_round_them(spark):
    df = clashing(corpus(spark))
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rates = mixing.balanced_rates(sized)
    by = {}
    for r in rates.collect():
        by.setdefault(r["source"], []).append((r["size"], r["units"] / mixing.UNIT, r["target"], r["source_size"]))
    for source, rows in by.items():
        size, rate, target = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), rows[0][2]
        assert abs((size * rate).sum() - target) <= 2e-5 * max(target, 1), source
        free = (size > 0) & (rate < 2.999) & (rate > 1e-3)
        if free.sum() > 1 and len(set(size[free])) > 1:  # the optimum has log rates in proportion to sizes
            slope = np.log(rate[free]) / size[free]
            assert np.ptp(slope) <= 1e-2 * abs(slope).max() + 1e-5, source
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert len(got) == df.count()
    for source in by:
        own = [r for r in got if r["source"] == source]
        taken, target = sum(r["copies"] * r["size"] for r in own), own[0]["target"]
        assert abs(taken - target) <= max(0.02 * target, max(r["size"] for r in own))
        assert all(0 <= r["copies"] <= 3 for r in own)
    again = mixing.mix(df.repartition(5))
    key = lambda r: (r["doc_id"], r["copies"], r["target"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))


def test_more_buckets_stay_near(spark):
    df = corpus(spark, 4)
    many = df
    for i in range(1, 4):
        many = many.unionByName(df.withColumn("doc_id", F.col("doc_id") + 1000 * i))
    sized = many.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.copies(mixing.balanced_rates(sized)).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("k"), F.max("target").alias("t"), F.max("size").alias("m"))
    assert all(abs(r["k"] - r["t"]) <= max(0.01 * r["t"], r["m"]) for r in out.collect())


def test_edge_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    silent = mixing.mix(docs(spark, [None, "", " \n"])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in silent] == [(0, 0.0, 1)] * 3
    one = mixing.mix(docs(spark, ["a b", "c"])).collect()
    assert {(r["target"], r["copies"]) for r in one} == {(3.0, 1)}
    repeated = docs(spark, ["a b c"] * 4).unionByName(docs(spark, ["a b c"] * 4))
    assert mixing.mix(repeated).count() == 8
    null_id = spark.createDataFrame([(None, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert mixing.mix(null_id).count() == 2


def test_rows_are_taken_as_often_as_the_mix_says(spark):
    df = docs(spark, [("a b c", "x"), ("d e", "y"), (None, "x"), ("", None)] + [(f"w{i} v", "xyz"[i % 3]) for i in range(200)])
    null = spark.createDataFrame([(None, f"n{i} m o", "en", "z", 6) for i in range(60)] + [(0, "a b c", "en", "x", 5)] * 3, df.schema)
    df = df.union(null)
    mixed = mixing.mix(df).groupBy().sum("copies").first()[0]
    got = mixing.mix_documents(df.withColumn("copies", F.lit(9))).collect()
    assert len(got) == mixed and set(got[0].asDict()) == {*df.columns, "copies"}
    per_null = Counter(r["text"] for r in got if r["doc_id"] is None)
    assert max(per_null.values(), default=0) <= 3  # not as often as the most taken of all rows without an id, for each of them



def test_word_count(spark):
    texts = ["", None, " a\t\x0bb\r\nc  ", " ", "a b"]
    got = docs(spark, texts).select(mixing.word_count(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 0, 3, 1, 1]


def test_plan_is_native(spark):
    plan = mixing.mix(corpus(spark, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
