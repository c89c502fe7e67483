"""Fitted models against direct numpy computations on small series."""

import datetime

import numpy as np
import pytest

from chronoloom.models.additive import AdditiveParams, additive_forecasts, additive_search, best_additive
from chronoloom.models.arima import arima_forecasts
from chronoloom.models.baseline import baseline_forecasts
from chronoloom.models.harmonic import harmonic_forecasts
from chronoloom.models import knn
from chronoloom.models.knn import knn_forecasts, knn_search
from chronoloom.models.linear import elastic_net, linear_forecasts
from chronoloom.models.smoothing import HoltPanel, SeasonalPanel, holt_forecasts, seasonal_forecasts
from chronoloom.models.svr import svr_forecasts, svr_search
from chronoloom.models.trees import tree_forecasts
from chronoloom.operators.gram import cross_products, solve_per_key
from chronoloom.operators.transforms import lag_block

K = ["key"]
H = 5


def preds(df, model=None):
    out = {}
    for r in df.orderBy("key", "step").collect():
        if model is None or r["model"] == model:
            out.setdefault(r["key"], []).append(r["pred"])
    return out


@pytest.fixture(scope="module")
def panel(spark):
    """Three keys of different scale and length with three regressors, one of them missing now and then."""
    rng = np.random.default_rng(0)
    rows, arrays = [], {}
    for k, n, size in (("a", 60, 1.0), ("b", 45, 1e4), ("c", 30, 10.0)):
        x = rng.normal(size=(n, 3)) * [1, 50, 0.1]
        y = size * (2 + x @ [1.0, -0.02, 3.0] + 0.1 * rng.normal(size=n))
        miss = rng.random(n) < 0.1
        miss[-H:] = False
        arrays[k] = (x, y, ~miss)
        for i in range(n):
            d = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
            rows.append((k, d, float(y[i]), float(x[i, 0]), None if miss[i] else float(x[i, 1]), float(x[i, 2])))
    df = spark.createDataFrame(rows, "key string, date date, y double, x1 double, x2 double, x3 double")
    return df.repartition(5).cache(), arrays


def direct(arrays, penalty):
    out = {}
    for k, (x, y, ok) in arrays.items():
        n = len(y)
        for i in range(n - H, n):
            use = ok[:i]
            xs, ys = x[:i][use], y[:i][use]
            mx, my = xs.mean(0), ys.mean()
            s = (xs - mx).T @ (xs - mx) + penalty * np.eye(3)
            out.setdefault(k, []).append(my + (x[i] - mx) @ np.linalg.solve(s, (xs - mx).T @ (ys - my)))
    return out


def test_every_origin_matches_a_direct_fit(panel):
    df, arrays = panel
    got = linear_forecasts(df, target="y", features=["x1", "x2", "x3"], horizon=H, keys=K, elastic_grid=None)
    for model, penalty in (("linear", 0.0), ("ridge", 1.0)):
        want = direct(arrays, penalty)
        for k, v in preds(got, model).items():
            assert np.allclose(v, want[k], rtol=1e-8)


def test_cross_products_do_not_depend_on_partitioning(panel):
    df, arrays = panel
    got = {}

    def total(m):
        import pandas as pd

        return pd.DataFrame([(m.total().ravel().tolist(),)], columns=["g"])

    for parts in (1, 7):
        cells = cross_products(df.repartition(parts), [df.y * 0 + 1, "y", "x1", "x2"], keys=K)
        got[parts] = {r["key"]: r["g"] for r in solve_per_key(cells, K, total, "g array<double>").collect()}
    for k, (x, y, ok) in arrays.items():
        z = np.column_stack([np.ones(len(y)), y, x[:, :2]])[ok]
        assert np.allclose(got[1][k], (z.T @ z).ravel()) and np.allclose(got[1][k], got[7][k])


def test_single_series_without_keys(panel):
    df, arrays = panel
    one = df.filter("key = 'a'").drop("key")
    got = linear_forecasts(one, target="y", features=["x1", "x2", "x3"], horizon=H, models=["linear"], elastic_grid=None)
    assert np.allclose([r["pred"] for r in got.orderBy("step").collect()], direct(arrays, 0.0)["a"])


@pytest.mark.parametrize("alpha,ratio", [(1.0, 1.0), (0.01, 0.5), (10.0, 0.1), (0.3, 0.9)])
def test_elastic_net_satisfies_its_optimality_conditions(alpha, ratio):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    x[:, 5] = x[:, 0] + 1e-3 * rng.normal(size=80)
    y = x @ [3, 0, -1, 0, 0.5, 0] + rng.normal(size=80)
    x, y = x - x.mean(0), y - y.mean()
    w = elastic_net(x.T @ x, x.T @ y, len(y), alpha, ratio)
    grad = x.T @ (y - x @ w) / len(y) - alpha * (1 - ratio) * w
    on = w != 0
    assert np.allclose(grad[on], alpha * ratio * np.sign(w[on]), atol=1e-6)
    assert (np.abs(grad[~on]) <= alpha * ratio + 1e-6).all()


def test_elastic_net_from_a_near_start_is_still_exact():
    rng = np.random.default_rng(4)
    x, noise = rng.normal(size=(200, 3)) * 1e6, rng.normal(size=200) * 1e6
    y = x @ [0.1, -0.05, 0.02] + noise
    x, y = x - x.mean(0), y - y.mean()
    cold = elastic_net(x.T @ x, x.T @ y, 200, 1.0, 0.3)
    warm = elastic_net(x.T @ x, x.T @ y, 200, 1.0, 0.3, start=cold + 1e-6)
    assert np.allclose(cold, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-9) and np.allclose(warm, cold, rtol=1e-12)


def test_elastic_grid_uses_the_fold_rule(panel):
    df, arrays = panel
    grid = {"alpha": [0.001, 1000.0], "l1_ratio": [0.5]}
    tuned = linear_forecasts(df, target="y", features=["x1", "x3"], horizon=H, keys=K, models=["elastic"], elastic_grid=grid)
    fixed = linear_forecasts(df, target="y", features=["x1", "x3"], horizon=H, keys=K, models=["elastic"],
                             elastic_params=(0.001, 0.5), elastic_grid=None)
    assert preds(tuned) == preds(fixed)


def test_constant_and_duplicate_columns_are_harmless(panel):
    from pyspark.sql import functions as F

    df, arrays = panel
    wide = df.withColumns({"one": F.lit(3.0), "twin": F.col("x1") * 2})
    got = linear_forecasts(wide, target="y", features=["x1", "x2", "x3", "one", "twin"], horizon=H, keys=K,
                           models=["linear"], elastic_grid=None)
    want = direct(arrays, 0.0)
    for k, v in preds(got).items():
        assert np.allclose(v, want[k], rtol=1e-6)


def test_baselines_by_hand(series):
    ys = [5, 1, 4, 2, 8, 6, 7]
    out = baseline_forecasts(series({"a": list(enumerate(ys))}), target="y", horizon=2, k=3, keys=K, with_actual=True)
    rows = {(r["model"], r["step"]): r["pred"] for r in out.collect()}
    assert rows["last", 0] == 8 and rows["last", 1] == 6
    assert rows["mean_latest", 1] == pytest.approx((2 + 8 + 6) / 3)
    assert rows["weight_last", 0] == pytest.approx((4 + 2 * 2 + 3 * 8) / 6)
    assert rows["mean_all", 0] == 4 and rows["median", 1] == 4.5 and rows["median_latest", 0] == 4
    assert {r["y"] for r in out.collect()} == {6, 7}


def test_baselines_with_one_row_and_fewer_rows_than_the_window(series):
    df = series({"one": [(0, 3)], "two": [(0, 3), (1, 5)]})
    out = baseline_forecasts(df, target="y", horizon=4, k=3, keys=K)
    assert {(r["key"], r["step"]) for r in out.collect()} == {("two", 3)}
    assert {r["pred"] for r in out.collect()} == {3.0}


def test_knn_by_brute_force(panel):
    df, arrays = panel
    for p, weights in ((1, "uniform"), (2, "distance")):
        got = preds(knn_forecasts(df, target="y", features=["x1", "x2", "x3"], horizon=H, keys=K, k=4, p=p, weights=weights))
        for k, (x, y, ok) in arrays.items():
            want = []
            for i in range(len(y) - H, len(y)):
                use = np.flatnonzero(ok[:i])
                d = (np.abs(x[use] - x[i]) ** p).sum(1) ** (1 / p)
                near = np.argsort(d, kind="stable")[:4]
                w = np.ones(4) if weights == "uniform" else 1 / d[near]
                want.append((w @ y[use][near]) / w.sum())
            assert np.allclose(got[k], want)


def test_pivots_leave_out_block_pairs_but_no_neighbour(spark):
    rng = np.random.default_rng(11)
    n = 4000
    walk = np.cumsum(rng.normal(size=n)) + 1e6
    x = np.stack([walk, np.r_[walk[0], walk[:-1]]], axis=1)
    x[100:140] = x[50]  # ties
    x[7] = [np.inf, 0.0]  # near nothing
    y = rng.normal(size=n)
    key = np.where(np.arange(n) < 3900, "a", None)  # a null key is a key, here with few rows
    data = [(k, i, int(i * 3 // n) if k else int(i % 2), float(y[i]), x[i].tolist()) for i, k in enumerate(key)]
    rows = spark.createDataFrame(data, "k string, r long, fold int, y double, x array<double>")
    found = knn.fold_neighbours(rows, ["k"], [1, 2], 9)
    got = {(r["p"], r["r"]): [(c["d"], c["__row"]) for c in r["near"]] for r in found.near.collect()}
    fold = np.array([d[2] for d in data])
    for p in (1, 2):
        for i in [*rng.integers(0, n, 300), 7, 50, 105, 3950, 3999]:
            others = np.flatnonzero((fold != fold[i]) & ((key == None) == (key[i] is None)))  # noqa: E711
            gap = np.abs(x[others] - x[i])
            with np.errstate(invalid="ignore"):
                d = gap.sum(1) if p == 1 else np.sqrt((gap * gap).sum(1))
            some = np.argsort(d, kind="stable")[:9]
            assert got[p, i] == [(d[j], others[j]) for j in some if np.isfinite(d[j])]
    assert found.met.count() < 0.5 * found.possible.count()
    assert found.met.count() == found.met.distinct().count()


def test_knn_search_by_brute_force(panel):
    df, arrays = panel
    grid = {"n_neighbors": [1, 3, 7], "weights": ["uniform", "distance"], "p": [1, 2]}
    got = {r["key"]: (r["n_neighbors"], r["weights"], r["p"]) for r in
           knn_search(df, target="y", features=["x1", "x2"], horizon=H, keys=K, grid=grid).collect()}
    for key, (x, y, ok) in arrays.items():
        use = np.flatnonzero(ok)
        use = use[use < len(y) - 1]
        x2, y2 = x[use][:, :2], y[use]
        folds = np.array_split(np.arange(len(use)), 3)
        scores = {}
        for n in grid["n_neighbors"]:
            for w in grid["weights"]:
                for p in grid["p"]:
                    mse = []
                    for held in folds:
                        train = np.setdiff1d(np.arange(len(use)), held)
                        err = []
                        for i in held:
                            d = (np.abs(x2[train] - x2[i]) ** p).sum(1) ** (1 / p)
                            near = np.argsort(d, kind="stable")[:n]
                            ww = np.ones(n) if w == "uniform" else 1 / d[near]
                            err.append((y2[i] - ww @ y2[train][near] / ww.sum()) ** 2)
                        mse.append(np.mean(err))
                    scores[n, w, p] = np.mean(mse)
        assert scores[got[key]] == pytest.approx(min(scores.values()))


def test_holt_scan_equals_a_plain_loop_whatever_the_batch_size(spark, series):
    rng = np.random.default_rng(3)
    data = {k: np.cumsum(rng.normal(size=40)) + 20 for k in "abc"}
    df = series({k: list(enumerate(v)) for k, v in data.items()})
    alphas, betas = (0.2, 0.7), (0.1, 0.5)
    want = {}
    for k, ys in data.items():
        for i in range(len(ys) - H, len(ys)):
            best = None
            for a in alphas:
                for b in betas:
                    level, trend, sse = ys[1], ys[1] - ys[0], 0.0
                    for y in ys[2:i]:
                        sse += (y - level - trend) ** 2
                        new = a * y + (1 - a) * (level + trend)
                        level, trend = new, b * (new - level) + (1 - b) * trend
                    if best is None or sse < best[0]:
                        best = (sse, level + trend)
            want.setdefault(k, []).append(best[1])
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = preds(holt_forecasts(df, target="y", horizon=H, keys=K, alphas=alphas, betas=betas))
        for k in data:
            assert np.allclose(got[k], want[k])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_holt_states_before_there_is_a_trend():
    s = HoltPanel(2, (0.5,), (0.5,))
    assert np.isnan(s.forecasts()).all()
    s.updates(np.array([4.0, np.nan]))
    assert s.forecasts()[0] == 4.0 and np.isnan(s.forecasts()[1])


def test_seasonal_state_learns_a_clean_season():
    y = [10 + 0.5 * t + [3, -1, -4, 2][t % 4] for t in range(60)]
    s = SeasonalPanel(2, "add", "add", 4, (0.05, 0.4, 0.9))
    for i, v in enumerate(y[:-1]):
        s.updates(np.array([v, v if i >= 7 else np.nan]))
    assert s.forecasts()[0] == pytest.approx(y[-1], abs=0.3) and s.n.tolist() == [59, 52]
    m = SeasonalPanel(1, "mul", "mul", 4, (0.4,))
    m.updates(np.array([-1.0]))
    assert m.dead[0] and np.isnan(m.forecasts()[0]) and m.criteria()[0] == np.inf


def test_seasonal_forecasts_beat_the_last_value(series):
    rng = np.random.default_rng(8)
    ys = [100 + t + 20 * np.sin(2 * np.pi * t / 7) + rng.normal() for t in range(90)]
    df = series({"a": list(enumerate(ys)), "short": list(enumerate(ys[:6]))})
    got = preds(seasonal_forecasts(df, target="y", horizon=H, keys=K))
    truth, last = np.array(ys[-H:]), np.array(ys[-H - 1 : -1])
    assert np.abs(np.array(got["a"]) - truth).mean() < 0.3 * np.abs(last - truth).mean()
    assert got["short"] == [None] * 5


def test_arma_recovers_a_simulated_process(series):
    rng = np.random.default_rng(11)
    data = {}
    for k, phi in (("a", 0.8), ("b", -0.5)):
        e, y = rng.normal(size=500), [0.0]
        for t in range(1, 500):
            y.append(3 + phi * y[-1] + e[t] + 0.4 * e[t - 1])
        data[k] = y
    df = series({k: list(enumerate(v)) for k, v in data.items()})
    got = preds(arima_forecasts(df, target="y", horizon=20, keys=K, d=0, max_p=2, max_q=2, name="arima_eda"))
    for k, y in data.items():
        err = np.array(y[-20:]) - np.array(got[k])
        assert err.std() < 1.6 and abs(err.mean()) < 0.8


def test_arima_differences_a_random_walk(series):
    rng = np.random.default_rng(12)
    walk = np.cumsum(rng.normal(size=300)) + 50
    noise = rng.normal(size=300) + 5
    df = series({"walk": list(enumerate(walk)), "noise": list(enumerate(noise))})
    out = arima_forecasts(df, target="y", horizon=H, keys=K, max_p=1, max_q=1, detail=True)
    rows = {(r["key"], r["step"]): r for r in out.collect()}
    assert {rows["walk", s]["d"] for s in range(H)} == {1} and {rows["noise", s]["d"] for s in range(H)} == {0}
    err = [rows["walk", s]["pred"] - walk[-H + s] for s in range(H)]
    assert np.abs(err).mean() < 2.5


def test_exogenous_arma_uses_the_regressor(panel):
    df, arrays = panel
    got = preds(arima_forecasts(df.fillna(0.0), target="y", horizon=H, keys=K, d=0, max_p=1, max_q=1, long_lags=3,
                                exogenous=["x1", "x2", "x3"], name="arima_exo_eda"))
    y = arrays["a"][1]
    assert np.abs(np.array(got["a"]) - y[-H:]).mean() < 0.5 * y.std()


def test_harmonic_regression_on_two_seasons(series):
    t = np.arange(200)
    y = 50 + 0.1 * t + 5 * np.sin(2 * np.pi * t / 7) + 3 * np.cos(2 * np.pi * t / 30)
    got = preds(harmonic_forecasts(series({"a": list(enumerate(y))}), target="y", horizon=H, keys=K, periods=(7, 30)))
    assert np.allclose(got["a"], y[-H:], atol=0.05)
    got = preds(harmonic_forecasts(series({"a": list(enumerate(np.exp(y / 20)))}), target="y", horizon=H, keys=K, log=True))
    assert np.allclose(got["a"], np.exp(y[-H:] / 20), rtol=0.01)


def test_additive_model_trend_season_holiday(spark, series):
    t = np.arange(400)
    start = datetime.date(2020, 1, 6)
    hol = [start + datetime.timedelta(days=int(i)) for i in range(50, 400, 60)] + [start + datetime.timedelta(days=397)]
    bump = np.array([8.0 * ((start + datetime.timedelta(days=int(i))) in hol) for i in t])
    y = 30 + 0.05 * t + np.where(t > 150, 0.1 * (t - 150), 0) + 4 * np.sin(2 * np.pi * t / 7) + bump
    holidays = spark.createDataFrame([(d,) for d in hol], "date date")
    df = series({"a": list(enumerate(y))})
    got = preds(additive_forecasts(df, target="y", horizon=H, keys=K, holidays=holidays,
                                   params=AdditiveParams(changepoint_prior_scale=0.5)))
    assert np.allclose(got["a"], y[-H:], atol=1.0)
    multiplicative = preds(additive_forecasts(df, target="y", horizon=H, keys=K, holidays=holidays,
                                              params=AdditiveParams(seasonality_mode="multiplicative")))
    logistic = preds(additive_forecasts(df, target="y", horizon=H, keys=K, params=AdditiveParams(growth="logistic", cap=200.0)))
    assert np.allclose(multiplicative["a"], y[-H:], rtol=0.2) and np.allclose(logistic["a"], y[-H:], rtol=0.25)


def test_additive_search_prefers_the_season_that_is_there(series):
    t = np.arange(300)
    df = series({"a": list(enumerate(20 + 5 * np.sin(2 * np.pi * t / 7) + 0.02 * t))})
    grid = [AdditiveParams(weekly_seasonality=False), AdditiveParams(weekly_seasonality=True)]
    scores = additive_search(df, grid, target="y", horizon=H, initial_days=120, horizon_days=40, keys=K)
    rmse = {r["candidate"]: r["rmse"] for r in scores.collect()}
    assert rmse[1] < 0.3 * rmse[0]
    assert best_additive(scores, K).first()["candidate"] == 1


def test_svr_follows_a_smooth_curve(series):
    rng = np.random.default_rng(2)
    y = 3 * np.sin(np.arange(150) / 5) + 0.1 * rng.normal(size=150)
    df = lag_block(series({"a": list(enumerate(y))}), ["y"], 2, K)
    got = preds(svr_forecasts(df, target="y", features=["lag_y_1", "lag_y_2"], horizon=H, keys=K, C=100.0))
    assert np.abs(np.array(got["a"]) - y[-H:]).mean() < 0.5
    best = svr_search(df, target="y", features=["lag_y_1", "lag_y_2"], horizon=H, keys=K,
                      grid={"kernel": ["rbf"], "C": [1e-4, 100.0], "epsilon": [0.1]}).first()
    assert best["C"] == 100.0


def test_trees_take_rows_with_missing_features(panel):
    df, arrays = panel
    params = {"n_estimators": 10, "max_depth": 4, "max_features": None, "min_samples_split": 2}
    for kind, refit in (("rf", "once"), ("gbt", "once"), ("rf", "each")):
        got = preds(tree_forecasts(df, target="y", features=["x1", "x2", "x3"], horizon=2, keys=K, kind=kind, params=params,
                                   refit=refit))
        assert all(len(v) == 2 and None not in v for v in got.values())


def test_tree_grid_search(panel):
    df, _ = panel
    got = preds(tree_forecasts(df, target="y", features=["x1", "x2"], horizon=2, keys=K, params={"n_estimators": 5},
                               grid={"max_depth": [1, 3]}))
    assert set(got) == {"a", "b", "c"}


def test_user_columns_may_have_any_everyday_name(panel):
    df, arrays = panel
    plain = df.withColumnRenamed("y", "target")
    odd = plain.withColumnsRenamed({"target": "n", "x1": "rn", "x2": "y", "x3": "z"})
    for make in (linear_forecasts, knn_forecasts):
        a = preds(make(plain, target="target", features=["x1", "x2", "x3"], horizon=H, keys=K))
        b = preds(make(odd, target="n", features=["rn", "y", "z"], horizon=H, keys=K))
        assert a == b
    a = preds(arima_forecasts(plain.fillna(0.0), target="target", horizon=H, keys=K, max_p=1, max_q=1, exogenous=["x1", "x2"]))
    b = preds(arima_forecasts(odd.fillna(0.0), target="n", horizon=H, keys=K, max_p=1, max_q=1, exogenous=["rn", "y"]))
    assert a == b
    assert preds(holt_forecasts(plain, target="target", horizon=H, keys=K)) == preds(holt_forecasts(odd, target="n", horizon=H, keys=K))
    params = {"n_estimators": 3, "max_depth": 2}
    a = preds(tree_forecasts(plain, target="target", features=["x1", "x2"], horizon=2, keys=K, params=params))
    b = preds(tree_forecasts(odd, target="n", features=["rn", "y"], horizon=2, keys=K, params=params))
    assert set(a) == set(b)
