"""Linear forecasters refitted at every origin from summed cross products: OLS, ridge, lasso, elastic net."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.backtest import contiguous_fold
from chronoloom.operators.frame import off_level, with_step
from chronoloom.operators.gram import (
    KeyMoments,
    centred,
    cross_products,
    fit,
    least_squares,
    residual_sum,
    solve_per_key,
    varying_columns,
)

# Model names in declared order, and the penalty search grid.
LINEAR_MODELS = ("linear", "lasso", "ridge", "elastic")
ELASTIC_GRID = {"alpha": [0.01, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]}
FOLDS = 3


def sparse_fit(sxx: np.ndarray, sxy: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """argmin SSE/2 + sum(l1 * |w|) + sum(l2 / 2 * w^2) on centred cells, exactly; columns with l1 = 0 are always in.

    An active set: columns enter one at a time, the one whose pull exceeds its l1 most, and leave where a step to the exact
    solution of the present signs would pass zero. Every step lowers the objective, so no set comes twice.
    """
    p = len(sxy)
    d = np.sqrt(np.clip(np.diag(sxx) + l2, 1e-300, None))
    a, b, c, r = sxx / np.outer(d, d), sxy / d, l1 / d, l2 / d**2  # columns of like size
    w, free = np.zeros(p), l1 == 0
    sign = np.zeros(p)
    active = free.copy()
    tiny = 1e-10 * max(np.abs(b).max(initial=0.0), 1e-300)

    def exact(active: np.ndarray) -> np.ndarray:
        on, out = np.flatnonzero(active), np.zeros(p)
        if on.size:
            out[on] = least_squares(a[np.ix_(on, on)], b[on] - c[on] * sign[on], r[on])
        return out

    for _ in range(20 * p + 100):
        goal = exact(active)
        crossing = active & ~free & (goal * sign < 0)
        if crossing.any():  # go as far as the first column that would change its sign, which leaves
            at = np.flatnonzero(crossing)
            share = w[at] / np.where(w[at] == goal[at], 1.0, w[at] - goal[at])
            first = at[np.argmin(share)]
            w = w + np.clip(share.min(), 0.0, 1.0) * (goal - w)
            w[first], sign[first], active[first] = 0.0, 0.0, False
            continue
        w = goal
        pull = b - a @ w - r * w
        over = np.where(active, -np.inf, np.abs(pull) - c)
        enter = int(np.argmax(over)) if p else 0
        if not p or over[enter] <= tiny:
            break
        active[enter], sign[enter] = True, np.sign(pull[enter])
    return w / d


def elastic_net(sxx, sxy, n, alpha, l1_ratio, start=None, sweeps=2000, tol=1e-10):
    """argmin SSE/(2n) + alpha*(l1*|w| + (1-l1)/2*w^2) on centred cells.

    Coordinate descent finds the sign pattern; the exact solution for that pattern replaces it as soon as it
    satisfies the optimality conditions.
    """
    p = len(sxy)
    a, b = sxx / n, sxy / n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(p) if start is None or len(start) != p else start.copy()
    grad = b - a @ w
    diag = np.diag(a) + l2
    signs = None
    for _ in range(sweeps):
        change = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            rho = grad[j] + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / diag[j]
            step = new - w[j]
            if step:
                grad -= a[:, j] * step
                w[j] = new
                change = max(change, abs(step) * diag[j])  # in units of b
        now = np.sign(w)
        if signs is not None and (now == signs).all():
            on = np.flatnonzero(now)
            exact = np.zeros(p)
            if on.size:
                exact[on] = least_squares(a[np.ix_(on, on)], b[on] - l1 * now[on], l2)
            slack = np.abs(b - a @ exact - l2 * exact)
            fits = (np.sign(exact) == now).all() and (slack[now == 0] <= l1 * (1 + 1e-9) + 1e-12).all()
            if fits:
                return exact
        signs = now
        if change <= tol * max(np.abs(b).max(initial=0.0), 1e-300):
            break
    return w


def _search(m: KeyMoments, xs: list[int], grid: list[tuple[float, float]], upto: int) -> tuple[float, float]:
    """Best (alpha, l1_ratio) by mean squared error over contiguous folds; first one wins ties."""
    folds = {b: g.copy() for b, g in m.gram.items()}
    for i in range(upto):
        if m.complete(i):
            z = m.rows[i]
            folds[m.blocks[i]] = folds.get(m.blocks[i], 0) + np.outer(z, z)
    folds = {b: g for b, g in folds.items() if g[0, 0] > 0}
    if len(folds) < 2:
        return grid[0]
    whole = sum(folds.values())
    score = np.zeros(len(grid))
    for held in folds.values():
        train = whole - held
        used = varying_columns(train, xs)
        n, mx, my, sxx, sxy, _ = centred(train, used)
        for g, (alpha, ratio) in enumerate(grid):
            w = elastic_net(sxx, sxy, n, alpha, ratio)
            score[g] += residual_sum(held, my - mx @ w, w, used) / held[0, 0]
    return grid[int(np.argmin(score))]


def _forecasts(models, ridge_alpha, lasso_alpha, elastic_params, grid, tune_on):
    def run(m: KeyMoments) -> pd.DataFrame:
        xs = list(range(2, m.width - 1))  # the last column is the level taken off the target
        gram = m.total() if m.width else np.zeros((0, 0))
        chosen = elastic_params
        if "elastic" in models and grid:
            chosen = _search(m, xs, grid, len(m.steps) - 1 if tune_on == "newest" else 0)
        warm: dict[str, tuple] = {}
        out = []
        for i, step in enumerate(m.steps):
            z = m.rows[i]
            usable = gram[0, 0] >= 2
            for name in models:
                pred = np.nan
                if usable:
                    if name in ("linear", "ridge"):
                        b0, beta, used = fit(gram, xs, ridge_alpha if name == "ridge" else 0.0)
                    else:
                        used = varying_columns(gram, xs)
                        n, mx, my, sxx, sxy, _ = centred(gram, used)
                        alpha, ratio = (lasso_alpha, 1.0) if name == "lasso" else chosen
                        old = warm.get(name)
                        beta = elastic_net(sxx, sxy, n, alpha, ratio, old[1] if old and old[0] == used else None)
                        warm[name] = (used, beta)
                        b0 = my - mx @ beta
                    pred = z[-1] + b0 + (z[used] @ beta if used else 0.0)
                out.append((int(step), m.dates[i], name, None if not np.isfinite(pred) else float(pred)))
            if m.complete(i):
                gram = gram + np.outer(z, z)
        return pd.DataFrame(out, columns=["step", "date", "model", "pred"])

    return run


def linear_forecasts(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    models: Sequence[str] = LINEAR_MODELS,
    ridge_alpha: float = 1.0,
    lasso_alpha: float = 1.0,
    elastic_params: tuple[float, float] = (1.0, 0.5),
    elastic_grid: Mapping[str, Sequence[float]] | None = ELASTIC_GRID,
    tune_on: str = "newest",
) -> DataFrame:
    """Every origin is trained on all complete rows before it.

    `tune_on="newest"` searches the elastic-net grid on all rows before the newest origin and reuses the result for
    the older ones; `"oldest"` uses only rows before the first origin, which avoids looking ahead.
    """
    grid = list(product(elastic_grid["alpha"], elastic_grid["l1_ratio"])) if elastic_grid else []
    base = with_step(df.select(*keys, date, target, *features), keys, horizon, date)
    whole_row = F.lit(True)
    for c in (target, *features):
        whole_row = whole_row & F.col(c).isNotNull()
    in_tuning = F.col("__row") < F.col("__rows") if tune_on == "newest" else F.col("step").isNull()
    base = base.withColumn("__fold", contiguous_fold(whole_row & in_tuning, FOLDS, keys, date))
    base = off_level(base, [target, *features], keys)
    z = [F.lit(1.0), target, *features, f"__level_{target}"]
    parts = cross_products(base, z, keys=keys, date=date, step="step", block="__fold")
    run = _forecasts(tuple(models), ridge_alpha, lasso_alpha, tuple(elastic_params), grid, tune_on)
    return solve_per_key(parts, keys, run, "step int, date date, model string, pred double", carried=1)
