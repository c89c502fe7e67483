"""Histogram trees against plain ones, the side of missing values, and the number of passes."""

import datetime

import numpy as np
import pytest

from chronoloom.models import trees
from chronoloom.models.trees import BINS, Tree, TreeSettings, best_splits, fall, tree_forecasts

K = ["key"]


def frame(spark, columns, names, key="a"):
    start = datetime.date(2020, 1, 1)
    rows = [(key, start + datetime.timedelta(days=i), *(None if v is None or v != v else float(v) for v in r)) for i, r in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, "key string, date date, " + ", ".join(f"{n} double" for n in names))


def plain_best(bins, y, least):
    """The best split by trying all of them."""
    best = (0.0, None)
    whole = y.sum() ** 2 / len(y)
    for f in range(bins.shape[1]):
        lost = bins[:, f] == BINS
        for edge in range(BINS):
            for side in (True, False):
                left = np.where(lost, side, bins[:, f] <= edge)
                if least <= left.sum() <= len(y) - least and 0 < left.sum() < len(y):
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - whole
                    if gain > best[0] + 1e-9:
                        best = (gain, tuple(left))
    return best


@pytest.mark.parametrize("least", [1, 8])
def test_splits_equal_trying_all(least):
    rng = np.random.default_rng(1)
    for _ in range(8):
        bins = rng.integers(0, 6, (60, 3)).astype(np.uint8)
        bins[rng.random((60, 3)) < 0.2] = BINS
        y = rng.normal(size=60) + (bins[:, 1] > 2)
        n, s = (np.stack([np.bincount(bins[:, f], w, BINS + 1) for f in range(3)])[None] for w in (np.ones(60), y))
        (_, feature, edge, lost, value, n_left, n_right, v_left, v_right), = best_splits(n, s, least, np.ones((1, 3), bool))
        gain, left = plain_best(bins, y, least)
        got = np.where(bins[:, feature] == BINS, lost, bins[:, feature] <= edge)
        assert np.isclose(y[got].sum() ** 2 / got.sum() + y[~got].sum() ** 2 / (~got).sum() - y.sum() ** 2 / 60, gain)
        assert (n_left, n_right) == (got.sum(), 60 - got.sum()) and np.isclose([v_left, v_right, value], [y[got].mean(), y[~got].mean(), y.mean()]).all()


def test_rows_fall_as_splits_say():
    t = Tree()
    t.split({0: (1, 3, True, 0.0, 5, 5, -1.0, 1.0)}, 1, False)
    t.split({0: (0, 0, False, -1.0, 2, 3, -2.0, -0.5)}, 1, True)
    bins = np.array([[0, 3], [5, 2], [0, 4], [BINS, 0], [0, BINS], [9, BINS]], np.uint8)
    assert t.arrays()[4][fall(t.arrays(), bins)].tolist() == [-2.0, -0.5, 1.0, -0.5, -2.0, -0.5] and t.open == []


def test_a_missing_value_tells(spark):
    """Where a feature's absence says what comes, forecasts follow it, on whichever side of the split that is."""
    rng = np.random.default_rng(2)
    for sign in (1, -1):
        lost = rng.random(200) < 0.3
        lost[-5:] = [True, False, True, False, True]
        side = rng.normal(size=200)
        x = np.where(lost, np.nan, np.round(side + np.sign(side), 1))  # fewer values than bins, so that each has its own
        y = np.where(lost, 10.0 + 5 * sign, np.where(x > 0, 10.0 + 4 * sign, 10.0)) + 0.01 * rng.normal(size=200)
        for kind in ("rf", "gbt"):
            params = {"n_estimators": 20 if kind == "gbt" else 10, "max_depth": 3, "max_features": "all"} | ({"learning_rate": 0.3} if kind == "gbt" else {})
            got = [r["pred"] for r in tree_forecasts(frame(spark, (y, x), ("y", "x")), target="y", features=["x"], horizon=5, keys=K, kind=kind, params=params).orderBy("step").collect()]
            assert np.abs(np.array(got) - y[-5:]).max() < 0.5, (sign, kind)


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_a_step_function_is_learned_at_every_origin(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0.3, 5.0, -1.0) + np.where(x[:, 1] > 0, 2.0, 0.0) + 0.05 * rng.normal(size=400)
    df = frame(spark, (y, *x.T), ("y", "a", "b", "c"))
    params = {"n_estimators": 30, "max_depth": 4, "max_features": "all", "min_samples_split": 4} | ({"learning_rate": 0.3} if kind == "gbt" else {})
    got = [r["pred"] for r in tree_forecasts(df, target="y", features=["a", "b", "c"], horizon=20, keys=K, kind=kind, params=params).orderBy("step").collect()]
    assert len(got) == 20 and np.sqrt(np.mean((np.array(got) - y[-20:]) ** 2)) < 0.6
    again = [r["pred"] for r in tree_forecasts(df.repartition(5), target="y", features=["a", "b", "c"], horizon=20, keys=K, kind=kind, params=params).orderBy("step").collect()]
    assert np.allclose(got, again)


def test_passes_follow_the_depth_not_trees_and_origins(spark, monkeypatch):
    calls = []
    real = trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda *a: calls.append(len(a[1])) or real(*a))
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(2, 120)), ("y", "x"))
    out = tree_forecasts(df, target="y", features=["x"], horizon=20, keys=K, params={"n_estimators": 20, "max_depth": 3})
    assert out.count() == 20 and len(calls) == 3 and calls[0] == 400


def test_a_fit_written_down_between_rounds_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = frame(spark, rng.normal(size=(3, 150)), ("y", "x", "z"))
    out = []
    for folded in (2, 100):
        monkeypatch.setattr(trees, "FOLDED", folded)
        out.append([r["pred"] for r in tree_forecasts(df, target="y", features=["x", "z"], horizon=4, keys=K, kind="gbt", params={"n_estimators": 7, "max_depth": 2}).orderBy("step").collect()])
    assert np.allclose(*out)


def test_the_search_takes_the_candidate_that_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y = np.floor(x * 2) + 0.01 * rng.normal(size=300)
    df = frame(spark, (y, x), ("y", "x"))
    for kind in ("rf", "gbt"):
        rate = {"learning_rate": 0.5} if kind == "gbt" else {}
        got = [r["pred"] for r in tree_forecasts(df, target="y", features=["x"], horizon=5, keys=K, kind=kind, params={"n_estimators": 8, **rate}, grid={"max_depth": [1, 5]}).orderBy("step").collect()]
        deep = [r["pred"] for r in tree_forecasts(df, target="y", features=["x"], horizon=5, keys=K, kind=kind, params={"n_estimators": 8, "max_depth": 5, **rate}).orderBy("step").collect()]
        assert np.allclose(got, deep)


def test_odd_tables(spark):
    empty = frame(spark, ([], []), ("y", "x"))
    assert tree_forecasts(empty, target="y", features=["x"], horizon=2, keys=K).count() == 0
    nothing = frame(spark, ([None] * 6, [1.0] * 6), ("y", "x"))
    got = tree_forecasts(nothing, target="y", features=["x"], horizon=2, keys=K).collect()
    assert len(got) == 2
    flat = frame(spark, ([3.0] * 9, [None] * 9), ("y", "x")).drop("key")
    assert [r["pred"] for r in tree_forecasts(flat, target="y", features=["x"], horizon=2, kind="gbt").collect()] == [3.0, 3.0]
    nulls = frame(spark, (np.arange(30.0), np.arange(30.0)), ("y", "x"), key=None)
    assert all(r["key"] is None and r["pred"] is not None for r in tree_forecasts(nulls, target="y", features=["x"], horizon=3, keys=K).collect())


def test_feature_counts():
    def count(subset, p, kind="rf"):
        return TreeSettings(subset=subset).features(kind, p)

    assert [count(s, 9) for s in ("all", "auto", "sqrt", "log2", "0.5", "4", "99")] == [9, 3, 3, 4, 5, 4, 9]
    assert count("auto", 9, "gbt") == 9 and count("1.0", 9) == 9 and count("1", 9) == 1
    with pytest.raises(ValueError):
        TreeSettings.of("rf", {"max_features": "some"})
