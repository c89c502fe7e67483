import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import features, holidays, scaling
from tests.conftest import by_key

K = ["key"]
D = datetime.date


@pytest.mark.parametrize("method", ["minmax", "z_score", "robust_scaler"])
def test_scaling_round_trip(series, method):
    rng = random.Random(1)
    data = {k: [(i, rng.gauss(10, 5)) for i in range(30)] for k in "ab"} | {"flat": [(0, 2), (1, 2)]}
    df = series(data)
    stats = scaling.fit_scaler(df, ["y"], method, K)
    scaled = scaling.apply_scaler(df, stats, ["y"], K)
    at_once = by_key(scaling.scale_series(df, ["y"], method, K), "y")
    assert all(np.allclose(at_once[k], by_key(scaled, "y")[k]) for k in "ab")
    back = by_key(scaling.invert_scaler(scaled, stats, "y", ["y"], K), "y")
    for k in "ab":
        assert np.allclose(back[k], [v for _, v in data[k]])
    assert by_key(scaled, "y")["flat"] == [None, None]
    v = np.array([x for _, x in data["a"]])
    want = {"minmax": (v - v.min()) / np.ptp(v), "z_score": (v - v.mean()) / v.std(),
            "robust_scaler": (v - np.median(v)) / np.subtract(*np.percentile(v, [75, 25]))}[method]
    assert np.allclose(by_key(scaled, "y")["a"], want)


def test_scaling_without_keys_and_train_only(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 30.0)], "i int, y double")
    stats = scaling.fit_scaler(df, ["y"], "minmax", keep=F.col("i") < 3)
    assert [r["y"] for r in scaling.apply_scaler(df, stats, ["y"]).orderBy("i").collect()] == [0.0, 1.0, 3.0]
    long = scaling.stats_long(stats, ["y"], "minmax").first()
    assert (long["p1"], long["p2"]) == (0.0, 10.0)


def test_trailing_features_match_slices(series):
    rng = random.Random(2)
    data = {k: [rng.randint(0, 50) for _ in range(25)] for k in "ab"}
    df = series({k: list(enumerate(v)) for k, v in data.items()})
    spans = [("y", 1, 10), ("y", 12, 13), ("y", 0, 3)]
    out = features.add_trailing(df, means=spans, medians=spans, weighted=spans, keys=K)
    for v, a, b in spans:
        got = by_key(out, f"mean_{v}_{a}_{b}", f"median_{v}_{a}_{b}", f"mean_weighted_{v}_{a}_{b}")
        for k, ys in data.items():
            for i, row in enumerate(got[k]):
                part = ys[max(0, i - b) : max(0, i - a)]
                if not part:
                    assert row == (None, None, None)
                else:
                    w = np.arange(1, len(part) + 1)
                    assert np.allclose(row, (np.mean(part), np.median(part), np.average(part, weights=w)))


def test_weighted_mean_is_null_when_the_frame_holds_a_null(series):
    out = features.add_trailing(series({"a": list(enumerate([1, None, 3, 4, 5]))}), means=[("y", 0, 2)],
                                weighted=[("y", 0, 2)], keys=K)
    assert by_key(out, "mean_weighted_y_0_2")["a"] == [None, 1.0, None, None, pytest.approx((3 + 8) / 3)]
    assert by_key(out, "mean_y_0_2")["a"][2] == 1.0


def test_features_never_look_ahead(series):
    rng = random.Random(4)
    ys = [rng.random() for _ in range(20)]

    def built(values):
        df = series({"a": list(enumerate(values))})
        out = features.add_trailing(df, means=[("y", 0, 4)], medians=[("y", 1, 5)], weighted=[("y", 0, 4)], keys=K)
        return by_key(out, "mean_y_0_4", "median_y_1_5", "mean_weighted_y_0_4")["a"]

    changed = ys[:12] + [v + 100 for v in ys[12:]]
    assert built(ys)[:13] == built(changed)[:13]


def test_calendar_parts_week_rule(spark):
    days = [D(2021, 1, 1), D(2020, 12, 28), D(2018, 12, 31), D(2021, 1, 4), D(2020, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r["date"]: (r["Year"], r["Week"]) for r in features.add_calendar_parts(df, "weekly").collect()}
    assert got[D(2021, 1, 1)] == (2021, 0) and got[D(2020, 12, 28)] == (2020, 53)
    assert got[D(2018, 12, 31)] == (2018, 1) and got[D(2021, 1, 4)] == (2021, 1)
    daily = features.add_calendar_parts(df, "daily").filter("Month = 2").first()
    assert (daily["Year"], daily["Day"]) == (2020, 29)


def test_holiday_rules(spark):
    us = {(r["date"], r["name"]) for r in holidays.holiday_calendar(spark, "US", [2021]).collect()}
    assert (D(2021, 11, 25), "Thanksgiving") in us and (D(2021, 5, 31), "Memorial Day") in us
    assert (D(2021, 7, 5), "Independence Day (observed)") in us and (D(2021, 12, 31), "New Year's Day (observed)") in us
    aus = {(r["date"], r["name"]) for r in holidays.holiday_calendar(spark, "AUS", [2018, 2019, 2020]).collect()}
    assert {(D(2018, 3, 30), "Good Friday"), (D(2019, 4, 22), "Easter Monday"), (D(2020, 4, 10), "Good Friday")} <= aus
    with pytest.raises(ValueError):
        holidays.holiday_calendar(spark, "XX", [2020])


def test_holiday_features(spark):
    hol = spark.createDataFrame([("US", D(2020, 1, 1), "a"), ("US", D(2020, 1, 1), "b"), ("US", D(2020, 1, 2), "c")],
                                "country string, date date, name string")
    df = spark.createDataFrame([(D(2019, 12, 30), 1), (D(2020, 1, 6), 2)], "date date, i int")
    assert [r["holidays_fe"] for r in holidays.add_holidays(df, hol, "weekly").orderBy("i").collect()] == [2, 0]
    daily = spark.createDataFrame([(D(2020, 1, 2), 1), (D(2020, 1, 3), 2)], "date date, i int")
    assert [r["holidays_fe"] for r in holidays.add_holidays(daily, hol, "daily").orderBy("i").collect()] == [1, 0]


def test_feature_list_rules(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 2020, "t")],
                               "key string, date date, y double, difference double, lag_y_1 double, mean_y_1_2 double, Year int, s string")
    assert features.feature_columns(df, target="y", keys=K) == ["lag_y_1", "mean_y_1_2", "Year"]
    assert features.feature_columns(df, target="y", keys=K, lags=False) == ["mean_y_1_2", "Year"]
    assert features.feature_columns(df, target="y", keys=K, engineered=False) == ["lag_y_1"]


def test_constant_columns(series):
    df = series({"a": [(0, 1), (1, 1)], "b": [(0, 1), (1, 2)], "c": [(0, None)]})
    got = {r["key"]: r["is_constant"] for r in features.constant_columns(df, ["y"], K).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_pandas_agrees_on_interpolated_quantiles(series):
    v = pd.Series([3, 1, 4, 1, 5, 9, 2, 6], dtype=float)
    stats = scaling.fit_scaler(series({"a": list(enumerate(v))}), ["y"], "robust", K).first()
    assert stats["y__loc"] == v.median() and stats["y__scale"] == pytest.approx(v.quantile(0.75) - v.quantile(0.25))
