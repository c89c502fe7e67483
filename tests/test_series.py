import datetime
import random

from pyspark.sql import functions as F

from chronoloom.operators import missing, timegrid
from chronoloom.operators import transforms as tr
from chronoloom.operators.frame import assert_unique, head, row_at, tail, with_step
from tests.conftest import by_key

K = ["key"]
D = datetime.date


def test_bucket_aggregate_levels_and_null_sums(spark):
    rows = [("a", D(2020, 1, 6), 1.0, None, "x"), ("a", D(2020, 1, 12), 3.0, None, "w"), ("a", D(2020, 2, 1), None, 4.0, None),
            ("b", None, 9.0, 9.0, "z")]
    df = spark.createDataFrame(rows, "key string, d date, m double, s double, u string")
    out = timegrid.bucket_aggregate(df, ts="d", level="weekly", keys=K, means=["m"], sums=["s"], firsts=["u"])
    assert by_key(out, "date", "m", "s", "u") == {"a": [(D(2020, 1, 6), 2.0, 0.0, "x"), (D(2020, 1, 27), None, 4.0, None)]}
    month = timegrid.bucket_aggregate(df, ts="d", level="monthly", sums=["m"]).orderBy("date").collect()
    assert [(r["date"], r["m"]) for r in month] == [(D(2020, 1, 1), 4.0), (D(2020, 2, 1), 0.0)]


def test_calendar_has_no_gaps_and_keeps_rows(spark):
    rng = random.Random(3)
    rows = [(k, D(2019, 1, 1) + datetime.timedelta(days=d), float(d)) for k in "abc" for d in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "key string, date date, y double")
    out = by_key(timegrid.fill_calendar(df, level="daily", keys=K), "date", "y")
    for k, points in out.items():
        days = [p[0] for p in points]
        assert all((b - a).days == 1 for a, b in zip(days, days[1:]))
        assert sorted((d, y) for d, y in points if y is not None) == sorted((d, y) for kk, d, y in rows if kk == k)


def test_monthly_calendar_without_keys(spark):
    df = spark.createDataFrame([(D(2019, 11, 1), 1.0), (D(2020, 2, 1), 2.0)], "date date, y double")
    got = timegrid.fill_calendar(df, level="monthly").orderBy("date").collect()
    assert [(r["date"].month, r["y"]) for r in got] == [(11, 1.0), (12, None), (1, None), (2, 2.0)]


def test_missing_values_match_pandas(series):
    import pandas as pd

    values = {"a": [None, 1, None, None, 4, None, 2, None], "b": [None, None, 5], "c": [None, None], "d": [3]}
    df = series({k: list(enumerate(v)) for k, v in values.items()})
    for method, fn in {
        "substitute_backward": lambda s: s.ffill(),
        "substitute_forward": lambda s: s.bfill(),
        "substitute_interpolate": lambda s: s.interpolate(method="linear"),
    }.items():
        got = by_key(missing.repair(df, method, keys=K), "y")
        for k, v in values.items():
            want = [None if pd.isna(x) else x for x in fn(pd.Series(v, dtype=float))]
            assert got[k] == want, (method, k)
    for method, want in {"": [1, 4, 2], "substitute_by_value": [7, 1, 7, 7, 4, 7, 2, 7]}.items():
        assert by_key(missing.repair(df, method, keys=K, value=7), "y")["a"] == want
    mean = by_key(missing.repair(df, "substitute_by_mean", keys=K), "y")
    assert mean["a"][2] == 7 / 3 and "c" not in mean
    assert by_key(missing.repair(df, "substitute_by_median", keys=K), "y")["a"][0] == 2.0
    assert by_key(missing.repair(df, "substitute_by_value", keys=K, value="??"), "y")["b"] == [0, 0, 5]


def test_positions_and_steps(series):
    df = series({"a": [(i, i) for i in range(5)], "b": [(0, 9)]})
    got = by_key(with_step(df, K, 2), "step")
    assert got == {"a": [None, None, None, 0, 1], "b": [None]}
    assert by_key(tail(df, K, 2), "y") == {"a": [3, 4], "b": [9]}
    assert by_key(head(df, K, 2), "y") == {"a": [0, 1], "b": [9]}
    assert by_key(row_at(df, K, 1), "y") == {"a": [3]}
    assert by_key(tr.cut_extremes(df, K), "y") == {"a": [1, 2, 3]}


def test_differences_and_lags(series):
    rng = random.Random(5)
    data = {k: [(i, rng.randint(0, 99)) for i in range(12)] for k in "ab"}
    df = tr.lag_block(tr.differences(series(data), "y", K), ["y"], 3, K)
    df = tr.difference(tr.difference(df, "y", K, name="d1"), "d1", K, name="d2")
    for r in df.collect():
        assert r["difference"] == r["d1"] and r["secdifference"] == r["d2"]
    for k, rows in by_key(df, "y", "lag_y_1", "lag_y_2", "lag_y_3").items():
        ys = [v for _, v in data[k]]
        assert [r[3] for r in rows] == [None] * 3 + ys[:-3]
    shifted = by_key(tr.shift_columns(series(data), ["y"], K), "y")
    assert shifted["b"] == [None] + [v for _, v in data["b"]][:-1]


def test_lags_by_order_are_constant_beyond_it(series):
    df = series({"a": [(i, i + 1) for i in range(4)], "b": [(i, 5) for i in range(3)]})
    df = df.withColumn("k", F.when(F.col("key") == "a", 2).otherwise(1))
    got = by_key(tr.lag_block_by_order(df, ["y"], 2, "k", K), "lag_y_2")
    assert got == {"a": [None, None, 1, 2], "b": [0, 0, 0]}


def test_reshaping(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0)], "key string, step int, m1 double, m2 double")
    long = tr.to_long(df, ["key", "step"], ["m1", "m2"], "model", "pred")
    assert sorted((r["model"], r["pred"]) for r in long.collect()) == [("m1", 1.0), ("m2", 2.0)]
    assert tr.to_wide(long, ["key", "step"], "model", "pred", ["m1", "m2"]).first() == df.first()
    assert tr.stack_tables(df, df).count() == 2
    assert tr.divide_columns(df, ["m1"], 0).first()["m1"] is None


def test_duplicate_dates_fail(series):
    import pytest

    df = series({"a": [(0, 1), (0, 2)]})
    with pytest.raises(Exception, match="duplicate dates"):
        assert_unique(df, K).collect()
    assert assert_unique(series({"a": [(0, 1), (1, 2)]}), K).count() == 2


def test_partition_count_does_not_matter(spark, series):
    rng = random.Random(9)
    df = series({k: [(i, rng.random()) for i in range(0, 60, 3)] for k in "abcd"})

    def result():
        out = missing.interpolate(timegrid.fill_calendar(df, level="daily", keys=K), ["y"], K)
        return by_key(out, "date", "y")

    first = result()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert result() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
