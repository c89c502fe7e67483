"""Estimates on simulated data, optimality conditions, and levels that must not cost digits."""

import datetime

import numpy as np
import pandas as pd
import pytest

from chronoloom.models import smoothing
from chronoloom.models.additive import AdditiveParams, additive_forecasts, additive_search
from chronoloom.models.arima import ArmaFit, arima_forecasts
from chronoloom.models.linear import linear_forecasts, sparse_fit
from chronoloom.operators.gram import cross_products, fit, solve_per_key

K = ["key"]
DAY = datetime.date(2020, 1, 1)


def dates(n):
    return [DAY + datetime.timedelta(days=i) for i in range(n)]


def arma(rng, n, phi=0.0, theta=0.0, mean=0.0):
    e = rng.normal(size=n + 100)
    w = np.zeros(n + 100)
    for t in range(1, n + 100):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return w[100:] + mean


def start_of(w, p, q):
    """A plain start: small coefficients."""
    return np.array([[w.mean() * 0.5, *([0.1] * p), *([0.1] * q)]])


@pytest.mark.parametrize(("phi", "theta"), [(0.0, 0.8), (0.0, -0.8), (0.6, 0.4), (-0.5, 0.3)])
def test_likelihood_recovers_parameters(phi, theta):
    w = arma(np.random.default_rng(3), 500, phi, theta, 2.0)
    fits = ArmaFit(w, np.empty((500, 0)), [(1, 1)], 1, 1)
    beta, square, first = fits.estimate(start_of(w, 1, 1), 500)
    assert square[0] <= first[0] and abs(square[0] / 500 - 1) < 0.2
    if phi:
        assert abs(beta[0, 1] - phi) < 0.12 and abs(beta[0, 2] - theta) < 0.12
    alone = ArmaFit(w, np.empty((500, 0)), [(0, 1)], 1, 1).estimate(start_of(w, 1, 1), 500)[0]
    if not phi:
        assert abs(alone[0, 2] - theta) < 0.05 and abs(alone[0, 0] - w.mean()) < 0.1 and alone[0, 1] == 0


def test_likelihood_is_at_a_minimum_and_derivatives_are_right():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 1))
    w = arma(rng, 300, 0.5, 0.5) + 2 * x[:, 0]
    fits = ArmaFit(w, x, [(1, 1), (2, 0), (0, 2)], 2, 2)
    start = np.full((3, 6), 0.05)
    beta, square, first = fits.estimate(start, 300)
    assert (square <= first).all()
    for i in range(3):
        for j in np.flatnonzero(fits.used[i]):
            for h in (1e-3, -1e-3):
                moved = beta.copy()
                moved[i, j] += h
                assert fits.scan(moved, 300)[0][i] >= square[i] * (1 - 1e-9)
    at = np.full((3, 6), 0.2) * fits.used
    _, pull, *_ = fits.scan(at, 300)
    for i in range(3):
        for j in np.flatnonzero(fits.used[i]):
            up, down = at.copy(), at.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert np.isclose((fits.scan(up, 300)[0][i] - fits.scan(down, 300)[0][i]) / 2e-6, 2 * pull[i, j], rtol=1e-4)


def test_a_wild_start_is_left_without_its_moving_average():
    w = arma(np.random.default_rng(5), 200, 0.3, 0.0)
    fits = ArmaFit(w, np.empty((200, 0)), [(1, 1)], 1, 1)
    beta, square, first = fits.estimate(np.array([[0.0, 0.2, 50.0]]), 200)
    assert np.isfinite(square).all() and square[0] <= first[0] and abs(beta[0, 2]) < 1


def test_likelihood_forecasts_beat_the_two_stage_ones_on_a_moving_average(spark):
    rng = np.random.default_rng(6)
    rows = [(k, d, float(v)) for k in ("a", None, "c") for d, v in zip(dates(260), arma(rng, 260, 0.0, 0.9, 100.0))]
    rows += [("short", d, 1.0) for d in dates(3)]
    df = spark.createDataFrame(rows, "key string, date date, y double")
    out = {}
    for method in ("two_stage", "likelihood"):
        got = arima_forecasts(df, target="y", horizon=40, keys=K, d=0, max_p=1, max_q=1, method=method, detail=True).toPandas()
        assert len(got) == 3 * 40 + 2 and got["key"].isna().sum() == 40
        actual = {(k, d): y for k, d, y in rows}
        errors = [(r.pred - actual[None if pd.isna(r.key) else r.key, r.date]) ** 2 for r in got.itertuples() if r.key != "short"]
        out[method] = float(np.mean(errors))
        assert set(got.columns) >= {"d", "p", "q"}
    assert out["likelihood"] < 1.35 and out["likelihood"] <= out["two_stage"] * 1.02
    with pytest.raises(ValueError):
        arima_forecasts(df, target="y", horizon=4, keys=K, d=0, method="guess")


def test_later_origins_use_all_rows_before_them(spark):
    """The step from the sums of all earlier rows comes near an estimate made anew at that origin."""
    rng = np.random.default_rng(7)
    w = arma(rng, 200, 0.6, 0.3, 10.0)
    df = spark.createDataFrame([(d, float(v)) for d, v in zip(dates(200), w)], "date date, y double")
    got = [r["pred"] for r in arima_forecasts(df, target="y", horizon=10, d=0, max_p=1, max_q=1, method="likelihood", detail=True).orderBy("step").collect()]
    for i, t in enumerate(range(190, 200)):
        fits = ArmaFit(w - w.mean(), np.empty((200, 0)), [(p, q) for p in (0, 1) for q in (0, 1)], 1, 1)
        beta, square, _ = fits.estimate(np.full((4, 3), 0.1), t)
        states = fits.scan(beta, t + 1, [t])[-1][t]
        assert np.abs(states[0] + w.mean() - got[i]).min() < 0.05


@pytest.mark.parametrize("seed", range(6))
def test_sparse_fit_meets_its_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 12)) * 10.0 ** rng.integers(-2, 3, 12)
    x[:, 5] = x[:, 4] + 1e-4 * rng.normal(size=90)
    y = x @ (rng.normal(size=12) * (rng.random(12) < 0.4)) + rng.normal(size=90)
    x, y = x - x.mean(0), y - y.mean()
    l1 = np.where(np.arange(12) < 3, 0.0, np.abs(x.T @ y).max() * rng.random(12) * 0.2)
    l2 = np.where(np.arange(12) % 2, 0.0, 0.5)
    b = sparse_fit(x.T @ x, x.T @ y, l1, l2)
    pull = x.T @ (y - x @ b) - l2 * b
    size = np.sqrt((x * x).sum(0))
    on = b != 0
    assert np.allclose((pull - l1 * np.sign(b))[on] / size[on], 0, atol=1e-6 * np.abs(x.T @ y / size).max())
    assert (np.abs(pull[~on]) <= l1[~on] + 1e-6 * size[~on] * np.abs(x.T @ y / size).max()).all()
    assert (b[l1 > np.abs(x.T @ y).max() * 2] == 0).all()


def test_one_true_break_of_25_is_found():
    rng = np.random.default_rng(8)
    n, t = 400, np.linspace(0, 1, 400)
    places = 0.8 * np.arange(1, 26) / 25
    hinges = np.maximum(t[:, None] - places, 0)
    y = 1 + 2 * t - 6 * hinges[:, 12] + 0.05 * rng.normal(size=n)
    x = np.column_stack([t, hinges])
    x, yc = x - x.mean(0), y - y.mean()
    b = sparse_fit(x.T @ x, x.T @ yc, np.r_[0.0, np.full(25, 0.05**2 / 0.05)], np.zeros(26))
    found = np.flatnonzero(np.abs(b[1:]) > 0.3)
    assert set(found) <= {11, 12, 13} and abs(b[1:].sum() + 6) < 0.6 and (b[1:] == 0).sum() >= 18


@pytest.mark.parametrize("level", [0.0, 1e6, 1e9])
def test_a_level_costs_no_digits(spark, level):
    rng = np.random.default_rng(9)
    x = rng.normal(size=120)
    rows = [("a", d, float(50 + 3 * v), float(level + v)) for d, v in zip(dates(120), x)]
    df = spark.createDataFrame(rows, "key string, date date, y double, x double")
    flat = AdditiveParams(growth="flat", weekly_seasonality=False)
    got = [r["pred"] for r in additive_forecasts(df, target="y", horizon=10, keys=K, exogenous=["x"], params=flat).orderBy("step").collect()]
    exact = 50 + 3 * (np.float64(level) + x - level)[-10:]
    assert np.allclose(got, exact, atol=1e-5)
    got = linear_forecasts(df, target="y", features=["x"], horizon=10, keys=K, models=["linear"], elastic_grid=None).orderBy("step").collect()
    assert np.allclose([r["pred"] for r in got], exact, atol=1e-5)
    scores = additive_search(df, [flat, AdditiveParams(weekly_seasonality=False)], target="y", horizon=10, initial_days=30, horizon_days=20, keys=K, exogenous=["x"])
    assert all(r["rmse"] < 1e-3 for r in scores.collect() if r["candidate"] == 0)

    def slope(m):
        b0, beta, used = fit(m.total(), [2])
        plain = m.plain(b0, beta, used)
        return pd.DataFrame([(float(beta[0]), float(plain[0] + plain[2] * level))], columns=["b", "middle"])

    cells = cross_products(df.repartition(4), [df.x * 0 + 1, "y", "x"], keys=K)
    r = solve_per_key(cells, K, slope, "b double, middle double", carried=0).first()
    assert abs(r["b"] - 3) < 1e-5 and abs(r["middle"] - 50) < 1e-4


def test_a_null_key_keeps_its_scores(spark):
    rng = np.random.default_rng(10)
    rows = [(k, d, float(10 + i * 0.1 + rng.normal())) for k in (None, "a") for i, d in enumerate(dates(200))]
    df = spark.createDataFrame(rows, "key string, date date, y double")
    got = additive_search(df, [AdditiveParams()], target="y", horizon=5, initial_days=60, horizon_days=20, keys=K).collect()
    assert {r["key"] for r in got} == {None, "a"} and all(r["rmse"] < 3 for r in got)


def test_short_series_share_panels_of_bounded_size(monkeypatch):
    seen = []

    def panel(rows, keys, make, name):
        seen.append(rows["key"].nunique())
        return rows

    monkeypatch.setattr(smoothing, "_panel", panel)
    rows = pd.DataFrame({"key": np.arange(10_000), "last": True, "y": 1.0, "step": -1})
    out = pd.concat(smoothing._scan(["key"], None, "m")(iter([rows.iloc[:7_777], rows.iloc[7_777:]])))
    assert max(seen) <= smoothing.SERIES_AT_ONCE and out["key"].tolist() == list(range(10_000))
    seen.clear()
    long = pd.DataFrame({"key": np.repeat(np.arange(300), 5), "last": np.tile([False] * 4 + [True], 300), "y": 1.0, "step": -1})
    out = pd.concat(smoothing._scan(["key"], None, "m")(iter([long.iloc[:703], long.iloc[703:704], long.iloc[704:]])))
    assert max(seen) <= smoothing.SERIES_AT_ONCE and out["key"].tolist() == long["key"].tolist()
