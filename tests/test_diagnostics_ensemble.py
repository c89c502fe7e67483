import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import backtest, diagnostics, ensemble, metrics
from chronoloom.operators import stationarity as sta
from chronoloom.operators import transforms as tr
from tests.conftest import by_key

K = ["key"]


def ar_criterion(y, p, kind):
    n = len(y) - p
    x = np.column_stack([np.ones(n)] + [y[p - i : len(y) - i] for i in range(1, p + 1)])
    r = y[p:] - x @ np.linalg.lstsq(x, y[p:], rcond=None)[0]
    llf = -n / 2 * (np.log(2 * np.pi * (r @ r) / n) + 1)
    k = p + 2
    return -2 * llf + {"AIC": 2 * k, "BIC": k * np.log(n), "HQIC": 2 * k * np.log(np.log(n))}[kind]


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    out = {}
    for k, n in (("a", 120), ("b", 70)):
        y = [0.0, 1.0]
        for _ in range(n - 2):
            y.append(1 + 0.5 * y[-1] - 0.3 * y[-2] + rng.normal())
        out[k] = np.array(y)
    out["walk"] = np.cumsum(rng.normal(size=150)) + 30
    return out


@pytest.mark.parametrize("kind", ["AIC", "BIC", "HQIC"])
def test_lag_order_scores(series, noisy, kind):
    df = series({k: list(enumerate(v)) for k, v in noisy.items()})
    got = {(r["key"], r["lags"]): r["score"] for r in sta.lag_order_scores(df, "y", 6, criterion=kind, keys=K).collect()}
    best = {r["key"]: r["lag_order"] for r in sta.choose_lag_order(df, "y", 6, criterion=kind, keys=K).collect()}
    for k, y in noisy.items():
        want = [ar_criterion(y, p, kind) for p in range(1, 7)]
        assert np.allclose([got[k, p] for p in range(1, 7)], want)
        assert best[k] == int(np.argmin(want)) + 1


def test_lag_orders_stop_when_the_series_is_too_short(series):
    scores = sta.lag_order_scores(series({"s": list(enumerate([1, 5, 2, 8, 3, 9, 4]))}), "y", 5, keys=K)
    assert [r["lags"] for r in scores.orderBy("lags").collect()] == [1, 2]


def unit_root(y, lags):
    d = np.diff(y)
    n = len(d) - lags
    x = np.column_stack([np.ones(n), y[lags:-1]] + [d[lags - i : len(d) - i] for i in range(1, lags + 1)])
    t = d[lags:]
    b = np.linalg.lstsq(x, t, rcond=None)[0]
    r = t - x @ b
    s2 = r @ r / (n - x.shape[1])
    return b[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), r @ r


def test_unit_root_statistic_and_lag_choice(series, noisy):
    df = series({k: list(enumerate(v)) for k, v in noisy.items()})
    fixed = {r["key"]: r["stat"] for r in sta.unit_root_test(df, "y", keys=K, fixed_lag=2).collect()}
    auto = {r["key"]: r for r in sta.unit_root_test(df, "y", keys=K).collect()}
    for k, y in noisy.items():
        assert fixed[k] == pytest.approx(unit_root(y, 2)[0], rel=1e-6)
        cap = sta.default_test_lags(len(y))
        d = np.diff(y)
        scores = []
        for p in range(cap + 1):
            n = len(d) - cap
            x = np.column_stack([np.ones(n), y[cap:-1]] + [d[cap - i : len(d) - i] for i in range(1, p + 1)])
            r = d[cap:] - x @ np.linalg.lstsq(x, d[cap:], rcond=None)[0]
            scores.append(n * (np.log(2 * np.pi * (r @ r) / n) + 1) + 2 * (p + 2))
        assert auto[k]["used_lag"] == int(np.argmin(scores))
        assert auto[k]["stat"] == pytest.approx(unit_root(y, auto[k]["used_lag"])[0], rel=1e-6)
    assert auto["walk"]["p_value"] > 0.05 > auto["a"]["p_value"]


def test_difference_choice_and_leading_rows(series, noisy):
    second = np.cumsum(np.cumsum(np.random.default_rng(0).normal(size=150)))
    df = series({k: list(enumerate(v)) for k, v in (noisy | {"second": second, "tiny": [1.0, 2.0]}).items()})
    d = tr.differences(df, "y", K)
    orders = sta.choose_difference(d, "y", keys=K)
    got = {r["key"]: r["diff_order"] for r in orders.collect()}
    assert got == {"a": 0, "b": 0, "walk": 1, "second": 2, "tiny": 0}
    kept = sta.drop_leading(d.join(orders, "key"), "diff_order", keys=K)
    counts = {r["key"]: r["count"] for r in kept.groupBy("key").count().collect()}
    assert counts["second"] == 148 and counts["walk"] == 149 and counts["a"] == 120
    shifted = sta.drop_leading(d.join(orders, "key"), "diff_order", keys=K, shifted=True)
    assert shifted.filter("key = 'a'").count() == 119


def test_correlation_is_pairwise_complete(series):
    rng = random.Random(6)
    ys = [rng.random() if rng.random() > 0.2 else None for _ in range(40)]
    df = tr.lag_block(series({"a": list(enumerate(ys))}), ["y"], 2, K)
    got = {(r["a"], r["b"]): r["corr"] for r in diagnostics.correlation_matrix(df, ["y", "lag_y_1", "lag_y_2"], K).collect()}
    s = pd.Series(ys, dtype=float)
    want = pd.DataFrame({"y": s, "lag_y_1": s.shift(1), "lag_y_2": s.shift(2)}).corr()
    assert all(got[a, b] == pytest.approx(want.loc[a, b]) for a in want for b in want)


def test_wide_correlation_agrees_with_narrow(series):
    rng = random.Random(7)
    df = series({"a": [(i, rng.random()) for i in range(30)]})
    wide = tr.lag_block(df, ["y"], 18, K)
    cols = ["y"] + [f"lag_y_{i}" for i in range(1, 19)]
    got = {(r["a"], r["b"]): r["corr"] for r in diagnostics.correlation_matrix(wide, cols, K).collect()}
    few = {(r["a"], r["b"]): r["corr"] for r in diagnostics.correlation_matrix(wide, cols[:4], K).collect()}
    assert len(got) == 19 * 19 and all(got[p] == pytest.approx(v) for p, v in few.items())
    assert diagnostics.varying(diagnostics.correlation_matrix(wide.withColumn("c", F.lit(1.0)), ["y", "c"], K)).count() == 1


def test_report_columns():
    cols = ["y", "x", "lag_y_1", "mean_y_1_3", "median_y_1_3", "holidays_fe", "Year"]
    assert diagnostics.correlation_columns(cols, "y", lags=True) == ["y", "lag_y_1"]
    assert diagnostics.correlation_columns(cols, "y", extra=["x"], holidays=True, date_parts=["Year", "Week"]) == [
        "y", "x", "mean_y_1_3", "median_y_1_3", "holidays_fe", "Year"]


def test_points_and_bins(spark):
    df = spark.createDataFrame([(float(i), float(i % 10)) for i in range(150)], "x double, y double")
    binned = diagnostics.binned_counts(df, "x", "y", bins=5)
    assert binned.agg(F.sum("rows"), F.max("bin_x"), F.min("bin_y")).first() == (150, 4, 0)
    assert diagnostics.scatter_points(df, "x", "y").count() == 150


def test_decomposition_reassembles_the_series(series):
    t = np.arange(40)
    y = 10 + 0.3 * t + np.array([2, -1, 0, 4, -3, 1, -3])[t % 7]
    df = series({"a": list(enumerate(y)), "short": list(enumerate(y[:13]))})
    out = diagnostics.decompose(df, "y", "daily", K)
    rows = out.filter("trend is not null").collect()
    assert {r["key"] for r in rows} == {"a"} and len(rows) == 34
    assert all(abs(r["trend"] + r["seasonal"] + r["resid"] - r["observed"]) < 1e-9 for r in rows)
    assert max(abs(r["resid"]) for r in rows) < 1e-9
    assert sum({r["date"].weekday(): r["seasonal"] for r in rows}.values()) == pytest.approx(0, abs=1e-9)


def test_autocorrelations_by_hand(series, noisy):
    df = series({k: list(enumerate(v)) for k, v in noisy.items()})
    acf = {(r["key"], r["lag"]): r["acf"] for r in diagnostics.autocorrelation(df, "y", 6, K).collect()}
    pacf = {(r["key"], r["lag"]): r["pacf"] for r in diagnostics.partial_autocorrelation(df, "y", 6, K).collect()}
    for k, y in noisy.items():
        c = y - y.mean()
        r = [1.0] + [c[i:] @ c[:-i] / (c @ c) for i in range(1, 7)]
        assert np.allclose([acf[k, i] for i in range(7)], r)
        for p in range(1, 7):
            toeplitz = np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)])
            assert pacf[k, p] == pytest.approx(np.linalg.solve(toeplitz, r[1 : p + 1])[-1])


def test_folds_and_cutoffs(series):
    df = series({"a": [(i, i) for i in range(11)], "b": [(i, i) for i in range(2)]})
    got = by_key(backtest.fold_table(df, 3, K), "fold")
    assert got == {"a": [0] * 4 + [1] * 4 + [2] * 3, "b": [0, 1]}
    cuts = by_key(backtest.cutoffs(df, initial_days=3, horizon_days=4, keys=K), "cutoff", order="cutoff")
    start = datetime.date(2020, 1, 6)
    assert [(c - start).days for c in cuts["a"]] == [4, 6] and "b" not in cuts


def test_inverse_differences_restore_the_level(series):
    rng = random.Random(8)
    ys = [rng.random() for _ in range(15)]
    df = tr.differences(series({"a": list(enumerate(ys))}), "y", K)
    truth = backtest.actuals(df, target="y", horizon=4, keys=K)
    own = backtest.origins(df, horizon=4, keys=K)
    for order, c in ((1, "difference"), (2, "secdifference"), (0, "y")):
        p = own.select("key", "step", F.col(c).alias("pred"))
        back = backtest.undo_differences(p, truth, order=order, keys=K)
        assert np.allclose(by_key(back, "pred", order="step")["a"], ys[-4:])


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = random.Random(10)
    rows = []
    for k in "ab":
        for s in range(12):
            y = rng.uniform(5, 10)
            for m in ("m1", "m2", "m3", "b1"):
                rows.append((k, s, datetime.date(2020, 1, 1 + s), m, y + rng.gauss(0, 1), y))
    df = spark.createDataFrame(rows, "key string, step int, date date, model string, pred double, y double")
    return ensemble.label(df, {"ts": ["m1", "m2"], "tabular": ["m3"], "baseline": ["b1"]}).cache()


def test_family_average_is_between_its_members(forecasts):
    avg = ensemble.family_averages(forecasts, K).filter("model = 'ts_avg'")
    lim = forecasts.filter("family = 'ts'").groupBy("key", "step").agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"))
    assert avg.join(lim, ["key", "step"]).filter("pred >= lo and pred <= hi").count() == 24


def test_stacking_matches_direct_least_squares(forecasts):
    got = {(r["key"], r["model"], r["step"]): r["pred"] for r in ensemble.stacked_averages(forecasts, K).collect()}
    pdf = forecasts.filter("key = 'a' and family = 'ts'").toPandas().pivot(index="step", columns="model", values="pred")
    y = forecasts.filter("key = 'a' and model = 'm1'").orderBy("step").toPandas()["y"].to_numpy()
    x = pdf[["m1", "m2"]].to_numpy()
    for s in range(12):
        if s < 2 + int(0.15 * 12):
            want = x[s].mean()
        else:
            a = np.column_stack([np.ones(s), x[:s]])
            want = np.r_[1, x[s]] @ np.linalg.lstsq(a, y[:s], rcond=None)[0]
        assert got["a", "ts_wavg", s] == pytest.approx(want)


def test_selector_takes_the_recent_best(forecasts):
    pdf = forecasts.toPandas()
    got = {(r["key"], r["step"]): r for r in ensemble.select_model(forecasts, min_steps=4, keys=K).collect()}
    assert {s for _, s in got} == set(range(4, 12))
    for (k, s), r in got.items():
        part = pdf[(pdf.key == k) & (pdf.step >= s - 4) & (pdf.step < s)]
        mae = part.assign(e=(part.pred - part.y).abs()).groupby("model").e.mean()
        assert r["model"] == mae.idxmin() and r["window_mae"] == pytest.approx(mae.min())
        assert r["pred"] == pdf[(pdf.key == k) & (pdf.step == s) & (pdf.model == r["model"])].pred.iloc[0]
    kept = ensemble.select_model(forecasts, min_steps=4, keys=K, ignore_models=["m1"], exclude_families=["baseline"])
    assert {r["model"] for r in kept.collect()} <= {"m2", "m3"}


def test_selector_tie_goes_to_the_first_model(spark):
    rows = [(s, datetime.date(2020, 1, 1 + s), m, 2.0, 1.0) for s in range(4) for m in ("z", "a")]
    df = spark.createDataFrame(rows, "step int, date date, model string, pred double, y double")
    got = ensemble.select_model(ensemble.label(df, {"ts": ["z"], "baseline": ["a"]}), min_steps=2)
    assert {r["model"] for r in got.collect()} == {"z"}


def test_a_model_missing_at_one_step_is_skipped_there(spark):
    rows = [(s, datetime.date(2020, 1, 1 + s), m, None if (m, s) == ("a", 2) else 1.0 + (m == "b"), 1.0)
            for s in range(4) for m in ("a", "b")]
    df = ensemble.label(spark.createDataFrame(rows, "step int, date date, model string, pred double, y double"),
                        {"ts": ["a", "b"]})
    assert {r["step"]: r["pred"] for r in ensemble.family_averages(df).collect()}[2] == 2.0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", 1.0, 3.0), ("m", 4.0, 3.5), ("m", 0.0, 0.0)], "model string, y double, pred double")
    r = metrics.metric_table(df).first()
    e = np.array([-2.0, 0.5, 0.0])
    assert r["Rms"] == pytest.approx(np.sqrt((e**2).mean())) and r["Mae"] == pytest.approx(2.5 / 3)
    assert r["Mdn"] == 0.5 and r["Me"] == pytest.approx(0.5)
    assert r["Mp"] == pytest.approx(100 * (2 + 0.125) / 2)  # the zero actual is left out
    assert r["Hbb"] == pytest.approx((1.5 + 0.125) / 3)
    assert r["Q25"] == pytest.approx((1.5 + 0.125) / 3) and r["Q75"] == pytest.approx((0.5 + 0.375) / 3)


def test_summary_and_its_report_view(forecasts):
    every = forecasts.withColumn("family", F.when(F.col("model") == "b1", "baseline").otherwise(F.col("family")))
    table = metrics.metric_table(every, K, ("family", "model", "ord"))
    best = metrics.summary(table, K)
    assert best.count() == 2 * 2 * 3
    view = metrics.summary_view(best.filter("key = 'a'"), K).collect()
    assert [r["Type of approach"] for r in view[:3]] == ["Best baseline model", "Best time series model", "Best tabular model"]
    matrix = metrics.metric_matrix(table, ["m1", "b1"], K).filter("key = 'a' and Metric = 'Mae'").first()
    assert matrix["m1"] == pytest.approx(table.filter("key = 'a' and model = 'm1'").first()["Mae"])
    share = metrics.non_baseline_share(ensemble.select_model(forecasts, min_steps=4, keys=K), ["b1"], K)
    assert all(0 <= r["non_baseline_pct"] <= 100 for r in share.collect())


def test_small_helpers(spark, forecasts):
    df = spark.createDataFrame([(-3.0, 2.0, None), (None, None, None), (1.0, -1.0, 5.0)], "a double, b double, c double")
    assert [r["closest"] for r in ensemble.closest_to_zero(df, ["a", "b", "c"]).collect()] == [2.0, None, 1.0]
    assert [r["row_min"] for r in diagnostics.row_minimum(df, ["a", "b", "c"]).collect()] == [-3.0, None, -1.0]
    best = {r["key"]: r["mae"] for r in ensemble.best_model_per_key(forecasts, K).collect()}
    mean = {r["key"]: r["mean_mae"] for r in ensemble.mean_error_of_models(forecasts, K).collect()}
    assert all(best[k] <= mean[k] for k in "ab")
    counts = diagnostics.value_counts(forecasts, "model", K).filter("key = 'a'").collect()
    assert {r["times"] for r in counts} == {12}
    r2 = metrics.adjusted_r2(forecasts, 1, K).filter("key = 'a' and model = 'm1'").first()["adj_r2"]
    assert r2 < 1
