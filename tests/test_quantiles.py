"""Exact quantiles by range counts against numpy, in few values a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators.quantiles import exact_quantiles

P = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def frame(spark, data):
    rows = [(k, None if v is None else float(v)) for k, vs in data.items() for v in vs]
    return spark.createDataFrame(rows, "key string, v double").repartition(3)


@pytest.mark.parametrize(("bins", "at_most"), [(64, 4096), (8, 20), (2, 1)])
def test_equals_numpy(spark, bins, at_most):
    rng = np.random.default_rng(4)
    data = {
        "normal": rng.normal(size=900), "ties": rng.integers(0, 4, 500), "one": [3.5], "two": [1.0, 2.0],
        "tails": np.exp(rng.normal(0, 40, 300)), "level": 1e9 + rng.random(300), "same": [7.0] * 200,
        "huge": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], "tiny": [5e-324, 1e-323, 0.0, -5e-324], None: rng.random(100),
    }
    if at_most == 1:
        data = {k: v for k, v in data.items() if k in ("ties", "two", "tiny", "huge")}
    got = {r["key"]: r for r in exact_quantiles(frame(spark, data), "v", P, ["key"], bins=bins, at_most=at_most).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        v = np.sort(np.asarray(v, dtype=float))
        place = np.array(P) * (len(v) - 1)
        low, high, part = v[np.floor(place).astype(int)], v[np.ceil(place).astype(int)], place - np.floor(place)
        assert got[k]["n"] == len(v)
        np.testing.assert_allclose(got[k]["quantiles"], low * (1 - part) + high * part, rtol=1e-12)


def test_equals_the_buffered_aggregate(spark):
    df = spark.range(50_000).select((F.col("id") % 3).cast("string").alias("key"), F.rand(3).alias("v"))
    df = df.withColumn("v", F.when(F.col("key") == "0", F.floor(F.col("v") * 5)).otherwise(F.col("v")).cast("double")).cache()
    want = {r["key"]: r["q"] for r in df.groupBy("key").agg(F.percentile("v", F.array(*map(F.lit, P))).alias("q")).collect()}
    for r in exact_quantiles(df, "v", P, ["key"], at_most=500).collect():
        np.testing.assert_allclose(r["quantiles"], want[r["key"]], rtol=1e-12)


def test_unknown_and_endless_values(spark):
    inf, nan = float("inf"), float("nan")
    data = {"none": [None, nan], "mixed": [None, 1.0, nan, 3.0], "ends": [-inf, -inf, 1.0, inf, inf], "only": [inf, inf], "zero": [-0.0, 0.0, 0.0]}
    got = {r["key"]: (r["n"], r["quantiles"]) for r in exact_quantiles(frame(spark, data), "v", [0.0, 0.5, 0.8, 1.0], ["key"], at_most=1).collect()}
    assert got["none"] == (0, [None] * 4)
    assert got["mixed"] == (2, [1.0, 2.0, pytest.approx(2.6), 3.0])
    assert got["ends"] == (5, [-inf, 1.0, inf, inf])
    assert got["only"] == (2, [inf] * 4) and got["zero"] == (3, [0.0] * 4)


def test_without_keys_and_empty(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, "v", [0.25, 0.5], at_most=10).first()["quantiles"] == [25.0, 50.0]
    empty = spark.createDataFrame([], "key string, v double")
    assert exact_quantiles(empty, "v", [0.5], ["key"]).count() == 0
    assert exact_quantiles(empty, "v", [0.5]).first().asDict() == {"n": 0, "quantiles": [None]}
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", [1.5])


def test_final_groups_are_bounded(spark, monkeypatch):
    """What is put in order at the end has at most the stated number of values, from whatever spread."""
    import chronoloom.operators.quantiles as q

    sizes, within = [], q._within

    def watched(values, state, keys):
        out = within(values, state, keys)
        sizes.append((state, out))
        return out

    monkeypatch.setattr(q, "_within", watched)
    rng = np.random.default_rng(0)
    df = frame(spark, {"a": np.exp(rng.normal(0, 10, 3000)), "b": rng.random(50)})
    exact_quantiles(df, "v", [0.5], ["key"], at_most=100).collect()
    state, out = sizes[-1]
    assert out.groupBy("key", "__from", "__to").count().agg(F.max("count")).first()[0] <= 100
