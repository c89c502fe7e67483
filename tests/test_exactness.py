"""Regressions at any level, null keys, and settings that must not be dropped in silence."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.models.additive import AdditiveParams, additive_search
from chronoloom.models.linear import linear_forecasts
from chronoloom.models.trees import tree_forecasts
from chronoloom.operators import backtest, diagnostics, holidays
from chronoloom.operators.frame import attach, join_keys
from chronoloom.operators.stationarity import unit_root_test
from chronoloom.plans.run import svr_grid
from chronoloom.plans.spec import spec_from_dict

DAY = datetime.date(2020, 1, 6)
K = ["key"]


def days(spark, columns, schema):
    rows = [(k, DAY + datetime.timedelta(days=i), *[float(v) for v in values]) for k, data in columns.items() for i, values in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, f"key string, date date, {schema}")


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_a_regressor_far_from_zero_is_used(spark, offset):
    noise = np.random.default_rng(0).normal(size=60)
    df = days(spark, {"a": (3 * noise, offset + noise)}, "y double, x double")
    for keys in (K, []):
        got = linear_forecasts(df, target="y", features=["x"], horizon=5, keys=keys, models=["linear"], elastic_grid=None).collect()
        exact = dict(zip([DAY + datetime.timedelta(days=i) for i in range(60)], 3 * ((offset + noise) - offset), strict=True))
        assert max(abs(r["pred"] - exact[r["date"]]) for r in got) < 1e-6 * max(1, offset * 1e-6)


def test_a_constant_far_from_zero_is_still_constant(spark):
    noise = np.random.default_rng(1).normal(size=40)
    df = days(spark, {"a": (noise, np.full(40, 1e9 + 0.1))}, "y double, x double")
    got = linear_forecasts(df, target="y", features=["x"], horizon=3, keys=K, models=["linear"], elastic_grid=None).collect()
    for i, r in enumerate(sorted(got, key=lambda r: r["step"])):
        assert abs(r["pred"] - noise[: 37 + i].mean()) < 1e-9


def test_unit_root_does_not_depend_on_the_level(spark):
    walk = np.cumsum(np.random.default_rng(2).normal(size=120))
    df = days(spark, {"a": (walk,), "b": (walk + 1e9,)}, "y double")
    a, b = (r["stat"] for r in unit_root_test(df, "y", keys=K).orderBy("key").collect())
    assert abs(a - b) < 1e-4


def test_null_keys_are_joined_like_others(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "key string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "key string, w int")
    assert sorted((r["v"], r["w"]) for r in attach(left, right, K).collect()) == [(1, 10), (2, 20)]
    assert join_keys(left, right, K, "left").columns == ["key", "v", "w"]
    preds = spark.createDataFrame([(None, 0, 1.0), ("a", 0, 1.0)], "key string, step int, pred double")
    truth = spark.createDataFrame([(None, 0, 5.0, 1.0), ("a", 0, 7.0, 1.0)], "key string, step int, prev_level double, prev_diff double")
    back = backtest.undo_differences(preds, truth, order=1, keys=K)
    assert sorted(r["pred"] for r in back.collect()) == [6.0, 8.0]


def weekly(n, scale, seed=0):
    return scale * (10 + np.array([0, 3, 6, 9, 12, 15, 18])[np.arange(n) % 7] + np.random.default_rng(seed).normal(scale=0.01, size=n))


def lagged(spark, series):
    columns = {}
    for k, y in series.items():
        columns[k] = (y[7:], y[:-7])
    return days(spark, columns, "y double, lag_y_7 double")


PARAMS = {"n_estimators": 10, "max_depth": 5, "max_features": "all"}


def test_a_large_key_does_not_spoil_a_small_one(spark):
    small = weekly(90, 1.0)
    alone = lagged(spark, {"a": small})
    panel = lagged(spark, {"a": small, "b": weekly(90, 1e8, 1)})
    for df in (alone, panel):
        got = tree_forecasts(df, target="y", features=["lag_y_7"], horizon=3, keys=K, params=PARAMS).filter("key = 'a'").collect()
        truth = dict(df.filter("key = 'a'").select("date", "y").collect())
        assert max(abs(r["pred"] - truth[r["date"]]) for r in got) < 1.5


def test_a_newer_row_changes_a_later_forecast(spark):
    y = np.r_[np.full(40, 10.0) + np.random.default_rng(3).normal(scale=0.1, size=40), [50.0, 50.0, 50.0]]
    df = days(spark, {"a": (y[1:], y[:-1])}, "y double, lag double")
    got = {r["step"]: r["pred"] for r in tree_forecasts(df, target="y", features=["lag"], horizon=3, keys=K, params=PARAMS).collect()}
    once = {r["step"]: r["pred"] for r in tree_forecasts(df, target="y", features=["lag"], horizon=3, keys=K, params=PARAMS, refit="once").collect()}
    assert got[2] > once[2] + 1


def test_settings_that_trees_lack_raise(spark):
    df = days(spark, {"a": (np.arange(20.0), np.arange(20.0))}, "y double, x double")
    for bad in ({"max_depth": 31}, {"gamma": 1}):
        with pytest.raises(ValueError):
            tree_forecasts(df, target="y", features=["x"], horizon=2, keys=K, params=bad)
    with pytest.raises(ValueError):
        tree_forecasts(df, target="y", features=["x"], horizon=2, keys=K, params=PARAMS, refit="never")


def test_kernels_without_random_features_are_named():
    grid, notes = svr_grid({"kernel": ["sigmoid", "rbf"], "gamma": ["auto"]})
    assert grid["kernel"] == ["rbf"] and len(notes) == 2
    with pytest.raises(ValueError):
        svr_grid({"kernel": ["sigmoid"]})


def test_each_cap_is_scored_with_itself(spark):
    t = np.arange(120)
    df = days(spark, {"a": (90 / (1 + np.exp(-(t - 60) / 12)),)}, "y double")
    found = {}
    for caps in ((100.0, 1000.0), (1000.0, 100.0)):
        candidates = [AdditiveParams(growth="logistic", cap=c, weekly_seasonality=False) for c in caps]
        scores = additive_search(df, candidates, target="y", horizon=5, initial_days=60, horizon_days=10, keys=K)
        found[caps] = {caps[r["candidate"]]: r["rmse"] for r in scores.collect()}
    one, two = found.values()
    assert one[100.0] == pytest.approx(two[100.0]) and one[1000.0] == pytest.approx(two[1000.0]) and one[100.0] != pytest.approx(one[1000.0])


def test_both_additive_models_have_settings_of_their_own():
    spec = spec_from_dict({"model": {
        "prophet": {"cap": 1100, "prophet_initial": 300, "prophet_horizon": 30},
        "prophet_ex": {"cap": 30, "prophet_ex_initial": 100}}})
    assert spec.model.additive.params["cap"] == 1100 and spec.model.additive_exo.params["cap"] == 30
    assert (spec.model.additive_initial_days, spec.model.additive_exo_initial_days) == (300, 100)
    assert spec.model.additive_exo_horizon_days == 30
    assert spec_from_dict({"data_extraction": {"s3_route": "s3a://bucket/x"}}).extract.path == "s3a://bucket/x"


def test_a_year_without_a_calendar_is_not_known_to_be_free(spark):
    df = spark.createDataFrame([(datetime.date(2019, 7, 4),), (datetime.date(2020, 7, 4),), (datetime.date(2020, 7, 5),), (datetime.date(2021, 1, 1),)], "date date")
    with_2020 = holidays.add_holidays(df, holidays.holiday_calendar(spark, "US", [2020]), "daily")
    assert [r["holidays_fe"] for r in with_2020.orderBy("date").collect()] == [None, 1, 0, None]
    assert holidays.years_of(df) == [2019, 2020, 2021]
    aus = holidays.holiday_calendar(spark, "AUS", [2021]).where(F.col("date") == datetime.date(2021, 12, 28))
    assert aus.count() == 1  # Boxing Day of 2021 was a Sunday
    with pytest.raises(ValueError):
        holidays.holiday_calendar(spark, "US", [])


def test_sixty_columns_in_one_pass_with_levels_gaps_and_null_keys(spark):
    rng = np.random.default_rng(8)
    n, m = 900, 60
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, m)) + rng.normal(size=(n, m)) + 1e9
    x[rng.random((n, m)) < 0.1] = np.nan
    x[:, 5] = 7.0  # constant
    x[:, 6] = np.nan  # never there
    x[:, 7] = np.where(np.arange(n) % 2, np.nan, rng.normal(size=n))
    x[:, 8] = np.where(np.arange(n) % 2, 3.0, np.where(np.arange(n) % 4, 4.0, np.nan))  # constant where column 7 is present
    key = np.where(np.arange(n) % 3 == 0, None, "a")
    names = [f"c{i}" for i in range(m)]
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r]) for k, r in zip(key, x, strict=True)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    out = diagnostics.correlation_matrix(df, names, ["k"])
    got = {(r["k"], r["a"], r["b"]): r["corr"] for r in out.collect()}
    assert len(got) == 2 * m * m
    for k in (None, "a"):
        part = pd.DataFrame(x[[v == k for v in key]], columns=names)
        want = (part - part.mean()).corr()
        for a in names:
            for b in names:
                w, g = want.loc[a, b], got[k, a, b]
                both = part[[a, b]].dropna()
                if len(both) == 0 or both.nunique().min() < 2:
                    assert g is None, (a, b)
                else:
                    assert g == pytest.approx(w, abs=1e-6), (a, b)
    narrow = {(r["k"], r["a"], r["b"]): r["corr"] for r in diagnostics.correlation_matrix(df, names[:4], ["k"]).collect()}
    assert all(got[p] == pytest.approx(v, abs=1e-6) for p, v in narrow.items())
    whole = diagnostics.wide_correlations(df, names[:3]).collect()
    assert len(whole) == 9 and diagnostics.wide_correlations(df.limit(0), names[:3], ["k"]).count() == 0
    text = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("MapInArrow") == 1 and text.count("Scan ExistingRDD") == 1


def test_hexagons_hold_the_points_nearest_their_centres(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([*zip(map(float, x), map(float, y)), (None, 1.0), (1.0, None)], "x double, y double")
    got = {(r["hex_x"], r["hex_y"]): r["rows"] for r in diagnostics.hexagon_counts(df, "x", "y", across=12).collect()}
    u, v = (x - x.min()) / np.ptp(x) * 12, (y - y.min()) / np.ptp(y) * 6
    centres = np.array([(i, j) for i in range(26) for j in range(14) if i % 2 == j % 2]) / 2
    near = np.argmin((u[:, None] - centres[:, 0]) ** 2 + 3 * (v[:, None] - centres[:, 1]) ** 2, axis=1)
    want = {tuple((2 * centres[c]).astype(int)): n for c, n in zip(*np.unique(near, return_counts=True))}
    assert got == want
    flat = diagnostics.hexagon_counts(spark.createDataFrame([(2.0, 3.0)] * 4, "x double, y double"), "x", "y").collect()
    assert [(r["hex_x"], r["hex_y"], r["mid_x"], r["mid_y"], r["rows"]) for r in flat] == [(0, 0, 2.0, 3.0, 4)]


def test_wide_correlations_have_one_plan(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 20))
    names = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r["a"], r["b"]): r["corr"] for r in diagnostics.correlation_matrix(df, names).collect()}
    assert len(got) == 400
    assert np.allclose([[got[a, b] for b in names] for a in names], np.corrcoef(x.T))


def test_support_vector_plan_grows_by_a_constant(spark):
    from chronoloom.models.svr import svr_forecasts

    t = np.arange(60)
    df = days(spark, {"a": (np.sin(t / 5), t / 60.0)}, "y double, x double")
    sizes = []
    for rounds in (2, 3, 4, 5):
        plan = svr_forecasts(df, target="y", features=["x"], horizon=3, keys=K, rounds=rounds, dims=8)
        sizes.append(plan._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    steps = np.diff(sizes)
    assert steps.max() <= steps.min() + 2
