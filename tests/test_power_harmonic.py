"""Power transforms by profile likelihood, ARMA errors about harmonics."""

import datetime

import numpy as np
import pytest

from chronoloom.models.harmonic import POWERS, harmonic_forecasts, power_choice, power_harmonic_forecasts
from tests.conftest import by_key

K = ["key"]
H = 12


def simulated(power, n=600, phi=0.0, seed=5):
    rng = np.random.default_rng(seed)
    e = np.zeros(n)
    for t in range(1, n):
        e[t] = phi * e[t - 1] + rng.normal(0, 0.5)
    t = np.arange(n)
    z = 8 + 4 * t / n + 2 * np.sin(2 * np.pi * t / 7) + e
    return np.exp(z / 4) if power == 0 else (power * z + 1) ** (1 / power)


def likelihood(y, power, order=3, period=7):
    """The textbook form: normal errors of the transformed rows, and the Jacobian of the transform."""
    n = len(y)
    t = np.arange(1, n + 1)
    cols = [np.ones(n), t / (n + H)]
    for k in range(1, order + 1):
        cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    x = np.stack(cols, axis=1)
    z = np.log(y) if power == 0 else (y**power - 1) / power
    r = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
    return -n / 2 * np.log(r @ r / n) + (power - 1) * np.log(y).sum() - x.shape[1]


@pytest.mark.parametrize("power", [0.0, 0.3, 0.6, 1.0])
def test_power_is_recovered_and_most_likely(series, power):
    y = simulated(power)
    got = power_choice(series({"a": list(enumerate(y))}), target="y", horizon=H, keys=K, periods=(7,)).first()
    assert abs(got["power"] - power) <= 0.1
    best = max(((p, o) for p in POWERS for o in range(4)), key=lambda c: likelihood(y[:-H], *c))
    assert (got["power"], got["harmonics"]) == best


def test_coefficients_are_those_of_the_rows_as_they_came(series):
    y = simulated(1.0) + 1e6
    got = power_choice(series({"a": list(enumerate(y))}), target="y", horizon=H, keys=K, periods=(7,), powers=(1.0,), max_order=1).first()
    n = len(y) - H
    t = np.arange(1, n + 1)
    x = np.stack([np.ones(n), t / len(y), np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7)], axis=1)
    u = y[:n] / np.exp(np.log(y[:n]).mean()) - 1
    np.testing.assert_allclose(np.delete(got["coef"], 1), np.linalg.lstsq(x, u, rcond=None)[0], rtol=1e-5, atol=1e-12)


def test_forecasts_use_power_and_errors(series):
    """Multiplicative seasons with lasting errors: near the noise (0.5 / 4 on the log scale), far below the season alone."""
    data = {str(seed): simulated(0.0, phi=0.8, seed=seed) for seed in range(3)}
    df = series({k: list(enumerate(y)) for k, y in data.items()})
    args = dict(target="y", horizon=100, keys=K, periods=(7,))
    made = [power_harmonic_forecasts(df, **args), power_harmonic_forecasts(df, max_p=0, max_q=0, **args), harmonic_forecasts(df, **args)]
    rmse = []
    for out in made:
        pred = by_key(out, "pred")
        rmse.append(np.sqrt(np.mean([(np.log(pred[k]) - np.log(y[-100:])) ** 2 for k, y in data.items()])))
    assert rmse[0] < 1.15 * 0.125 and rmse[0] < 0.7 * rmse[1] and rmse[0] < 0.95 * rmse[2]


def test_future_rows_change_nothing_before_them(series):
    y = simulated(0.0)
    args = dict(target="y", horizon=H, keys=K, periods=(7,))
    changed = y.copy()
    changed[-3:] = [1.0, -5.0, 1e6]
    a, b = (by_key(power_harmonic_forecasts(series({"a": list(enumerate(v))}), **args), "pred")["a"] for v in (y, changed))
    np.testing.assert_allclose(a[: H - 2], b[: H - 2], rtol=1e-9)


def test_odd_keys(series, spark):
    rng = np.random.default_rng(1)
    negative = rng.normal(0, 1, 80)
    holes = [None if i % 9 == 4 else 5 + rng.random() for i in range(80)]
    df = series({"neg": list(enumerate(negative)), "holes": list(enumerate(holes)), "short": [(0, 1.0), (1, 2.0)],
                 "flat": [(i, 3.0) for i in range(60)], "none": [(i, None) for i in range(30)], None: list(enumerate(np.exp(negative)))})
    args = dict(target="y", horizon=H, keys=K, periods=(7,))
    chosen = {r["key"]: r["power"] for r in power_choice(df, **args).collect()}
    assert chosen["neg"] == 1.0 and "short" not in chosen and "none" not in chosen and None in chosen
    got = {}
    for r in power_harmonic_forecasts(df, **args).collect():
        got.setdefault(r["key"], []).append(r["pred"])
    assert {k: len(v) for k, v in got.items()} == {"neg": H, "holes": H, "short": 1, "flat": H, "none": H, None: H}
    assert got["flat"] == pytest.approx([3.0] * H) and set(got["short"] + got["none"]) == {None}
    assert all(v is not None for k in ("neg", "holes", None) for v in got[k])
    empty = spark.createDataFrame([], "key string, date date, y double")
    assert power_harmonic_forecasts(empty, **args).count() == 0


def test_without_keys(spark):
    y = simulated(0.0, n=200)
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    out = power_harmonic_forecasts(spark.createDataFrame(rows, "date date, y double"), target="y", horizon=5, periods=(7,)).collect()
    assert len(out) == 5 and all(r["pred"] > 0 for r in out)
