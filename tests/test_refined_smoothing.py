"""Smoothing weights beyond a grid: errors never rise, optima between grid points are found, memory stays bounded."""

import numpy as np
import pytest

from chronoloom.models import smoothing
from chronoloom.models.smoothing import HoltPanel, HoltSearch, SeasonalSearch, holt_forecasts, moved_through, seasonal_forecasts
from tests.conftest import by_key

K = ["key"]
H = 4
COARSE = (0.1, 0.5, 0.9)


def walks(count=5, n=60, seed=2):
    rng = np.random.default_rng(seed)
    trend = 100 + np.cumsum(rng.normal(0.3, 1.0, (count, n)), axis=1)
    return trend + rng.normal(0, 2.0, (count, n)) + 8 * np.sin(2 * np.pi * np.arange(n) / 4)


def newest(y, h=H):
    asked = np.zeros(y.shape, bool)
    asked[:, -h:] = True
    return asked


def holt_loss(y, a, b):
    """One series, one pair of weights, one row at a time."""
    level, trend, total = y[1], y[1] - y[0], 0.0
    for v in y[2:]:
        ahead = level + trend
        total += (v - ahead) ** 2
        level, trend = a * v + (1 - a) * ahead, b * (a * v + (1 - a) * ahead - level) + (1 - b) * trend
    return total, level + trend


SEARCHES = [HoltSearch(COARSE, COARSE), SeasonalSearch(("add", "mul"), ("add", "mul"), (4, 7), (0.1, 0.5))]


@pytest.mark.parametrize("search", SEARCHES, ids=["holt", "seasonal"])
def test_error_never_above_the_grids_and_falls_with_rounds(search):
    y = walks()
    asked = newest(y)
    loss = [moved_through(search, y, asked, rounds)[1][asked] for rounds in (1, 2, 4, 6)]
    assert all((b <= a).all() for a, b in zip(loss, loss[1:]))
    assert (loss[-1] < loss[0]).any()


def test_grid_loss_is_an_upper_bound_and_fine_grid_is_met():
    y = walks(count=3)
    asked = newest(y)
    found, loss = moved_through(HoltSearch(COARSE, COARSE), y, asked, 8)
    fine = np.linspace(0.005, 0.995, 100)
    for i in range(len(y)):
        for t in np.flatnonzero(asked[i]):
            coarse = min(holt_loss(y[i, :t], a, b)[0] for a in COARSE for b in COARSE)
            assert loss[i, t] <= coarse * (1 + 1e-12)
    i, t = 0, y.shape[1] - 1
    best = min(holt_loss(y[i, :t], a, b)[0] for a in fine for b in fine)
    assert loss[i, t] <= best * 1.005


def test_forecast_belongs_to_the_loss():
    """The point that gives the loss, found by trying all points of the last panel, gives the forecast."""
    y = walks(count=1)
    asked = newest(y, 1)
    found, loss = moved_through(HoltSearch(COARSE, COARSE), y, asked, 3)
    grid = np.array([(a, b) for a in np.arange(0.05, 1, 0.05) for b in np.arange(0.05, 1, 0.05)])
    panel = HoltPanel(1, (), (), np.round(grid, 10)[None])
    for v in y[0, :-1]:
        panel.updates(np.array([v]))
    for (a, b), total in zip(np.round(grid, 10), panel.sse[0]):
        assert total == pytest.approx(holt_loss(y[0, :-1], a, b)[0], rel=1e-9)
    assert loss[0, -1] <= panel.sse.min() * 1.02 and abs(found[0, -1] - panel.forecasts()[0]) < 3


def test_series_in_blocks_give_the_same(monkeypatch):
    y = walks(count=9)
    y[3, :20] = np.nan
    y[4, 30] = -1.0  # ends multiplicative candidates
    y[5, :] = np.nan
    y[6, 5:] = np.nan
    asked = newest(y)
    whole = [moved_through(s, y, asked, 3) for s in SEARCHES]
    monkeypatch.setattr(smoothing, "NUMBERS_AT_ONCE", 1)
    for s, (found, loss) in zip(SEARCHES, whole):
        f, l = moved_through(s, y, asked, 3)
        np.testing.assert_array_equal(f, found)
        np.testing.assert_array_equal(l, loss)


def test_panels_stay_within_the_bound(monkeypatch):
    seen = []
    about = HoltSearch.about

    def watched(self, kind, grid):
        seen.append(grid.shape[0] * grid.shape[1] * self.states[kind])
        return about(self, kind, grid)

    monkeypatch.setattr(HoltSearch, "about", watched)
    monkeypatch.setattr(smoothing, "NUMBERS_AT_ONCE", 2_000)
    y = walks(count=40)
    moved_through(SEARCHES[0], y, newest(y), 3)
    assert max(seen) <= 2_000 and len(seen) > 3


def test_spark_plan_takes_refinement(series):
    y = walks(count=2, n=40)
    df = series({"a": list(enumerate(y[0])), "b": list(enumerate(y[1])), "c": [(0, 1.0)], "d": [(0, None), (1, 2.0), (2, 3.0)]})
    got = by_key(holt_forecasts(df, target="y", horizon=H, keys=K, alphas=COARSE, betas=COARSE, refine=4).withColumnRenamed("step", "s"), "pred")
    want, _ = moved_through(SEARCHES[0], y, newest(y), 4)
    assert got["a"] == pytest.approx(want[0, -H:].tolist()) and got["b"] == pytest.approx(want[1, -H:].tolist())
    plain = by_key(holt_forecasts(df, target="y", horizon=H, keys=K, alphas=COARSE, betas=COARSE), "pred")
    assert plain["a"] != got["a"] and plain["d"] == got["d"]
    got = by_key(seasonal_forecasts(df, target="y", horizon=H, keys=K, periods=(4,), weights=(0.1, 0.5), refine=3), "pred")
    want, _ = moved_through(SeasonalSearch(("add", "mul"), ("add", "mul"), (4,), (0.1, 0.5)), y, newest(y), 3)
    assert got["a"] == pytest.approx(want[0, -H:].tolist()) and "c" not in got and len(got["d"]) == 2


def test_detail_gives_the_loss(series):
    y = walks(count=1, n=40)
    df = series({"a": list(enumerate(y[0]))})
    args = dict(target="y", horizon=H, keys=K, alphas=COARSE, betas=COARSE, detail=True)
    grid, fine = (by_key(holt_forecasts(df, refine=r, **args), "loss") for r in (0, 4))
    want = [min(holt_loss(y[0, :t], a, b)[0] for a in COARSE for b in COARSE) for t in range(36, 40)]
    assert grid["a"] == pytest.approx(want) and all(f < g for f, g in zip(fine["a"], grid["a"]))
